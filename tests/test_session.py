import math
from collections import Counter

import pytest

from halyard.operators import text_search
from halyard.plans.parser import SqlError, parse
from halyard.plans.session import Conflict, Duplicate, Engine


@pytest.fixture()
def db(spark, tmp_path):
    return Engine(spark, str(tmp_path)).session()


@pytest.fixture()
def boats(db):
    """Seven boats in three ports; two of them have a tonnage of 12."""
    db.script("""CREATE TABLE boats (boat INT PRIMARY KEY, flag VARCHAR(12), tons INT, home INT);
    CREATE TABLE ports (port INT PRIMARY KEY, town VARCHAR(20));
    INSERT INTO ports VALUES (1, 'Oban'), (2, 'Vigo'), (3, 'Kiel'), (4, 'Bari');
    INSERT INTO boats VALUES (10, 'red', 12, 1), (11, 'blue', 40, 1), (12, 'red', 7, 2), (13, 'white', 12, 2), (14, 'blue', 95, 2), (15, 'green', 3, 3), (16, 'red', 58, NULL)""")
    return db


def test_queries(boats):
    sql = lambda s: boats.sql(s).rows()
    assert sorted(sql("SELECT flag, COUNT(*) AS n, SUM(tons) AS t FROM boats GROUP BY flag")) == [("blue", 2, 135), ("green", 1, 3), ("red", 3, 77), ("white", 1, 12)]
    assert sorted(sql("SELECT flag FROM boats GROUP BY flag HAVING SUM(tons) > 70 && COUNT(*) >= 2")) == [("blue",), ("red",)]
    assert len(sql("SELECT DISTINCT tons FROM boats")) == 6
    assert sql("SELECT boat FROM boats ORDER BY tons DESC LIMIT 2 OFFSET 1") == [(16,), (11,)]
    assert sql("SELECT tons * 2 - 1 AS a, tons / 0 AS z, tons / 5 AS f FROM boats WHERE boat = 12") == [(13, 0, 1)]
    assert sorted(sql("SELECT boat FROM boats WHERE tons < 5 OR flag = 'white'")) == [(13,), (15,)]
    assert sorted(sql("SELECT home, flag FROM boats WHERE home > 0 GROUP BY home")) == [(1, "red"), (2, "red"), (3, "green")]  # of the smallest key
    assert sql("SELECT boat FROM boats ORDER BY home LIMIT 1") == [(16,)]  # null sorts first


def test_joins(boats):
    sql = lambda s: boats.sql(s).rows()
    assert sql("SELECT p.town, b.boat FROM boats b JOIN ports p ON b.home = p.port WHERE b.tons > 10 AND p.port < 3 ORDER BY b.tons") == [("Oban", 10), ("Vigo", 13), ("Oban", 11), ("Vigo", 14)]
    assert sorted(sql("SELECT p.town AS t, COUNT(b.boat) AS n FROM ports p LEFT JOIN boats b ON p.port = b.home GROUP BY p.town")) == [("Bari", 0), ("Kiel", 1), ("Oban", 2), ("Vigo", 3)]
    assert sql("SELECT COUNT(*) FROM boats CROSS JOIN ports") == [(28,)]
    assert len(sql("SELECT a.boat, b.boat FROM boats a JOIN boats b ON a.tons < b.tons")) == 20
    boats.script("CREATE TABLE crews (boat INT PRIMARY KEY, heads INT); INSERT INTO crews VALUES (11, 6), (14, 9), (99, 1)")
    assert sorted(sql("SELECT flag, heads FROM boats JOIN crews USING (boat)")) == [("blue", 6), ("blue", 9)]
    every = boats.sql("SELECT * FROM boats JOIN crews ON boats.boat = crews.boat")
    assert every.columns == ["boats.boat", "boats.flag", "boats.tons", "boats.home", "crews.boat", "crews.heads"]
    with pytest.raises(SqlError, match="ambiguous"):
        sql("SELECT boat FROM boats JOIN crews USING (boat)")


def test_changes(boats):
    assert boats.sql("UPDATE boats SET tons = tons + 1, flag = 'grey' WHERE tons < 10").affected == 2
    assert sorted(boats.sql("SELECT boat, tons FROM boats WHERE flag = 'grey'").rows()) == [(12, 8), (15, 4)]
    assert boats.sql("DELETE FROM boats WHERE home = 2").affected == 3
    with pytest.raises(Duplicate):
        boats.sql("INSERT INTO boats VALUES (10, 'red', 1, 1)")
    with pytest.raises(Exception, match="longer than 12"):
        boats.sql("INSERT INTO boats VALUES (70, 'a flag far too long', 1, 1)")
    with pytest.raises(Exception, match="null not allowed"):
        boats.sql("INSERT INTO boats VALUES (NULL, 'red', 1, 1)")
    with pytest.raises(SqlError, match="values expected"):
        boats.sql("INSERT INTO boats VALUES (71, 'red')")
    assert boats.sql("INSERT INTO boats VALUES " + ", ".join(f"({i}, 'new', {i}, 1)" for i in range(1000, 1300))).affected == 300
    assert boats.sql("TRUNCATE boats").affected == 304
    assert boats.sql("SELECT COUNT(*) AS n, MAX(tons) AS m FROM boats").rows() == [(0, None)]
    with pytest.raises(SqlError, match="PRIMARY KEY"):
        boats.sql("CREATE TABLE x (a INT, b INT)")


def test_places(db):
    """Points on a meridian, a degree being 111.195 km."""
    db.script("""CREATE TABLE spots (id INT PRIMARY KEY, p POINT);
    INSERT INTO spots VALUES (1, POINT(10, 20)), (2, 'POINT(10.01 20)'), (3, '10.02,20'), (4, POINT(10.05, 20)), (5, POINT(10, 20.5)), (6, NULL)""")
    near = db.sql("SELECT id FROM spots WHERE distancia(p, POINT(10, 20)) < 2300 ORDER BY id")
    assert [r[0] for r in near.rows()] == [1, 2, 3]
    knn = db.sql("SELECT id FROM spots WHERE LAT(p) > 0 ORDER BY distance(p, POINT(10.04, 20)) LIMIT 2")
    assert [r[0] for r in knn.rows()] == [4, 3] and "TakeOrderedAndProject" in knn.plan()
    square = "POLYGON(POINT(10, 20), POINT(10.02, 20), POINT(10.02, 21), POINT(10, 21))"
    assert [r[0] for r in db.sql(f"SELECT id FROM spots WHERE within(p, {square}) = true ORDER BY id").rows()] == [1, 2, 3, 5]  # the edge is inside
    assert db.sql("SELECT p FROM spots WHERE id = 2").rows() == [("POINT(10.01 20.0)",)]


def test_lists_of_an_ivf_index(spark, db):
    """Two far clusters: ORDER BY ... LIMIT reads the lists of one, also after changes; other queries read all rows."""
    db.sql("CREATE TABLE v (id INT PRIMARY KEY, x VECTOR(2))")
    rows = [(i, [float(i % 7), float(i // 7)]) for i in range(60)] + [(100 + i, [1000.0 + i, 1000.0]) for i in range(60)]
    db.insert_frame("v", spark.createDataFrame(rows, "id int, x array<float>"))
    db.sql("CREATE INDEX near ON v USING IVF (x) WITH (metric=l2, nlist=2, nprobe=1)")
    q = "SELECT id FROM v ORDER BY vector_distance(x, VECTOR(1004.2, 1000)) LIMIT 3"
    found = db.sql(q)
    assert [r[0] for r in found.rows()] == [104, 105, 103] and "list_id" in found.plan() and "PartitionFilters: [" in found.plan()
    assert found.df.sparkSession is spark and len(db.describe("v").indexes[0].centroids) == 2
    db.script("INSERT INTO v VALUES (500, VECTOR(1004.3, 1000)); DELETE FROM v WHERE id = 105")
    assert [r[0] for r in db.sql(q).rows()] == [500, 104, 103]
    assert [r[0] for r in db.sql("SELECT id FROM v WHERE id < 50 ORDER BY vector_distance(x, VECTOR(1004.2, 1000)) LIMIT 1").rows()] == [48]
    assert len(db.sql("SELECT id FROM v ORDER BY vector_distance(x, VECTOR(0, 0)) LIMIT 100").rows()) == 100  # more lists are read until it is enough
    with pytest.raises(SqlError, match="metric"):
        db.sql("SELECT id FROM v ORDER BY vector_distance(x, VECTOR(0, 1), 'cosine') LIMIT 1")
    with pytest.raises(Exception, match="components"):
        db.sql("INSERT INTO v VALUES (9000, VECTOR(1, 2, 3))")
    db.script("CREATE TABLE w (id INT PRIMARY KEY, x VECTOR(2)); CREATE INDEX nw ON w USING IVF (x) WITH (nlist=3); INSERT INTO w VALUES (1, '[0 0]')")
    assert db.sql("SELECT id FROM w ORDER BY vector_distance(x, VECTOR(0, 0)) LIMIT 5").rows() == [(1,)]  # too few rows for lists
    assert db.describe("w").indexes[0].centroids == []
    db.sql("INSERT INTO w VALUES (2, '[5 5]'), (3, '[9 9]')")
    assert len(db.describe("w").indexes[0].centroids) == 3


def test_ranked_search(spark, db, tmp_path):
    """BM25 against a plain computation; the index is stored once for each state of the table."""
    texts = ["faro y mar", "el mar, la mar y el faro viejo", "barcos viejos", "", "faros faros barco"]
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, body VARCHAR(80))")
    db.insert_frame("t", spark.createDataFrame(list(enumerate(texts)), "id int, body string"))

    def brute(query):
        tf = [Counter(text_search.analyse_query(t)) for t in texts]
        df, avg = Counter(w for c in tf for w in c), sum(sum(c.values()) for c in tf) / len(tf)
        out = {}
        for i, c in enumerate(tf):
            s = sum(math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg)) for w in set(text_search.analyse_query(query)) if c[w])
            if s > 0:
                out[i] = round(s, 9)
        return out

    for query in ("faro", "mar viejo", "barco barco faro"):
        got = db.sql(f"SELECT id, SCORE() AS s FROM t WHERE MATCH(body, '{query}') USING BM25").rows()
        assert {i: round(s, 9) for i, s in got} == brute(query) and [s for _, s in got] == sorted((s for _, s in got), reverse=True)
    kept = list((tmp_path / "_text").iterdir())
    assert len(kept) == 1
    db.sql("INSERT INTO t VALUES (9, 'un faro')")
    texts.append("un faro")
    assert {9 if i == 5 else i for i in brute("faro")} == {r[0] for r in db.sql("SELECT id FROM t WHERE MATCH(body, 'faro') USING BM25").rows()}
    assert len(list((tmp_path / "_text").iterdir())) == 2
    assert sorted(r[0] for r in db.sql("SELECT id FROM t WHERE MATCH(body, 'mar') > 0").rows()) == [0, 1]
    top = db.sql("SELECT *, SCORE() FROM t WHERE MATCH(body, 'faro') USING TF_IDF LIMIT 1").rows()
    assert len(top) == 1 and len(top[0]) == 3 and 0 < top[0][2] <= 1


def test_transactions(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    a, b = engine.session(), engine.session()
    a.script("CREATE TABLE till (id INT PRIMARY KEY, cents BIGINT); INSERT INTO till VALUES (7, 250), (8, 900), (9, 40)")
    a.script("BEGIN; UPDATE till SET cents = cents - 40 WHERE id = 7; SAVEPOINT before; DELETE FROM till WHERE id > 7")
    assert b.sql("SELECT COUNT(*), SUM(cents) AS s FROM till").rows() == [(3, 1190)]
    a.sql("ROLLBACK TO before")
    assert a.sql("SELECT SUM(cents) AS s FROM till").rows() == [(1150,)]
    b.sql("UPDATE till SET cents = cents + 5 WHERE id = 9")
    with pytest.raises(Conflict):
        a.sql("COMMIT")
    a.script("BEGIN; UPDATE till SET cents = cents - 40 WHERE id = 7; COMMIT")
    assert sorted(b.sql("SELECT id, cents FROM till").rows()) == [(7, 210), (8, 900), (9, 45)]
    a.script("BEGIN; DELETE FROM till; ROLLBACK")
    assert a.sql("SELECT COUNT(*) FROM till").rows() == [(3,)]
    with pytest.raises(SqlError, match="definitions"):
        a.script("BEGIN; DROP TABLE till")
    with pytest.raises(SqlError):
        parse("SELECT 1")


def test_broken_manifest(spark, tmp_path):
    """A writer that died between creating and writing a manifest leaves an empty or half one; nobody trips over it."""
    engine = Engine(spark, str(tmp_path))
    a, b = engine.session(), engine.session()
    a.script("CREATE TABLE t (id INT PRIMARY KEY); INSERT INTO t VALUES (1)")
    last = engine.store.latest()
    (tmp_path / "_manifests" / f"{last + 1:012d}.json").write_text("")
    (tmp_path / "_manifests" / f"{last + 2:012d}.json").write_text('{"t": {"na')
    assert b.sql("SELECT id FROM t").rows() == [(1,)] and engine.store.latest() == last
    b.sql("INSERT INTO t VALUES (2)")
    assert engine.store.latest() == last + 3 and sorted(a.sql("SELECT id FROM t").rows()) == [(1,), (2,)]
    assert not engine.store.commit(last, {}) and not list((tmp_path / "_manifests").glob("*.tmp"))


def test_drop_under_a_reader(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    a, b = engine.session(), engine.session()
    a.script("CREATE TABLE t (id INT PRIMARY KEY); INSERT INTO t VALUES (1), (2)")
    open_reader = b.sql("SELECT id FROM t").df
    a.script("DROP TABLE t; CREATE TABLE t (id INT PRIMARY KEY, word VARCHAR(4)); INSERT INTO t VALUES (5, 'new')")
    assert sorted(r.id for r in open_reader.collect()) == [1, 2]
    assert engine.store.vacuum() == []
    assert len(engine.store.vacuum(seconds=-1)) == 1  # the dropped table's folder
    assert b.sql("SELECT * FROM t").rows() == [(5, "new")]


def test_csv_import(db, tmp_path):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR(10), ok BOOL, p POINT, v VECTOR(2))")
    f = tmp_path / "in.csv"
    f.write_text('a,b,c,d,e\n1,"x",true,"-12 -77","[1, 2]"\n2,y\nbad,z,1,"1,2","3;4"\n3,w,false,"POINT(5 6)",0.5 1,extra\n4,,1,"7,8",1 1\n5,"",0,"7 8",1 1\n')
    out, bad = db.import_csv("t", str(f))
    assert out.affected == 4 and sorted(r._error for r in bad.collect()) == ["bad value in id", "too few fields"]
    assert db.sql("SELECT id, name, ok, p FROM t ORDER BY id").rows() == [(1, "x", True, "POINT(-12.0 -77.0)"), (3, "w", False, "POINT(5.0 6.0)"), (4, "", True, "POINT(7.0 8.0)"), (5, "", False, "POINT(7.0 8.0)")]
    db.sql("CREATE TABLE two (id INT PRIMARY KEY, word VARCHAR(5))")
    (tmp_path / "two.csv").write_text('id,word\n1,"x"\n2,""\n3,\n')
    assert db.import_csv("two", str(tmp_path / "two.csv"))[0].affected == 3
