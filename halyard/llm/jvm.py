"""Java functions of this package: compiled by the compiler that Spark's own code generation uses, and shipped as a jar."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def _package(spark: SparkSession, source: str, classes: list[str]) -> list:
    """One instance of each class; executors get the classes from a jar that the driver serves."""
    sc, jvm = spark.sparkContext, spark._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.Thread.currentThread().getContextClassLoader())
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), source), encoding="utf-8") as f:
        compiler.cook(f.read())
    jar = os.path.join(tempfile.mkdtemp(prefix="halyard-code-"), source.replace(".java", ".jar"))
    made = compiler.getBytecodes()
    with zipfile.ZipFile(jar, "w") as z:
        for name in made.keySet():
            z.writestr(name.replace(".", "/") + ".class", bytes(made[name]))
    sc._jsc.addJar(jar)
    none = sc._gateway.new_array(jvm.Class, 0), sc._gateway.new_array(jvm.Object, 0)
    return [compiler.getClassLoader().loadClass(c).getDeclaredConstructor(none[0]).newInstance(none[1]) for c in classes]


def functions(spark: SparkSession, source: str, classes: dict[str, str], returns: str) -> None:
    """Makes SQL functions {name: class} of a Java source beside this file known to the session."""
    sc = spark.sparkContext
    made = sc.__dict__.setdefault("_halyard_java", {})
    if source not in made:
        made[source] = _package(spark, source, list(classes.values()))
    kind = spark._jsparkSession.parseDataType(f'"{returns}"')
    for name, instance in zip(classes, made[source], strict=True):
        spark._jsparkSession.udf().register(name, instance, kind)
