"""Tokenizers as expressions, and the Snowball Spanish stemmer (applied once per distinct word, never per row)."""

from pyspark.ml.feature import StopWordsRemover


def match_tokens(x: str) -> str:
    """Lower-cased runs of letters and digits; no stop words, no stemming."""
    return f"filter(split(lower({x}), '[^\\\\p{{L}}\\\\p{{Nd}}]+'), t -> t <> '')"


def ranker_tokens(x: str) -> str:
    """Lower-cased runs of word characters without the underscore."""
    return f"filter(split(lower({x}), '[^\\\\p{{L}}\\\\p{{N}}]+'), t -> t <> '')"


#: Punctuation that the ranked-search analyser turns into spaces, and the accents it strips.
PUNCTUATION = ".,;:¡!¿?\"'()[]{}-_/"
ACCENTS, PLAIN = "áéíóúüñ", "aeiouun"


def clean_words(x: str) -> str:
    """Lower case, punctuation to spaces, split at white space."""
    quoted = PUNCTUATION.replace("\\", "\\\\").replace("'", "\\'")
    return f"filter(split(translate(lower({x}), '{quoted}', '{' ' * len(PUNCTUATION)}'), '\\\\s+'), t -> t <> '')"


def strip_accents(x: str) -> str:
    return f"translate({x}, '{ACCENTS}', '{PLAIN}')"


def stopwords(language: str = "spanish") -> list[str]:
    """Spark's own list; loads it through the running JVM."""
    return StopWordsRemover.loadDefaultStopWords(language)


# The published Snowball Spanish algorithm. Its suffix groups.
_VOWELS = set("aeiouáéíóúü")
_PRONOUNS = "selas selos sela selo las les los nos me se la le lo".split()
_GERUNDS_ACUTE = "iéndo ándo ár ér ír".split()
_GERUNDS = "ando iendo ar er ir".split()
_STEP1_DELETE = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_STEP1_IC = "adora ador ación adoras adores aciones ante antes ancia ancias acion".split()
_STEP2A = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_STEP2B_GU = "en es éis emos".split()
_STEP2B = "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos".split()
_STEP3_RV, _STEP3_E = "os a o á í ó".split(), "e é".split()
_ACUTE = str.maketrans("áéíóú", "aeiou")


def _regions(w: str) -> tuple[int, int, int]:
    def after_pair(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
                return i + 1
        return len(w)

    r1 = after_pair(0)
    r2 = after_pair(r1)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in _VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in _VOWELS), len(w))
        elif w[0] in _VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in _VOWELS), len(w))
        else:
            rv = 3
    return r1, r2, rv


def _longest(w: str, suffixes) -> str:
    return max((s for s in suffixes if w.endswith(s)), key=len, default="")


def spanish_stem(word: str) -> str:
    """Snowball Spanish stem of a lower-case word, acute accents removed from vowels."""
    w = word
    r1, r2, rv = _regions(w)

    def drop_if(suffixes, start: int) -> bool:
        nonlocal w
        s = _longest(w, suffixes)
        if s and len(w) - len(s) >= start:
            w = w[: len(w) - len(s)]
            return True
        return False

    pronoun = _longest(w, _PRONOUNS)  # step 0: an attached pronoun after a verb ending
    if pronoun and len(w) - len(pronoun) >= rv:
        base = w[: len(w) - len(pronoun)]
        end = _longest(base, [*_GERUNDS_ACUTE, *_GERUNDS, "yendo"])
        if end and len(base) - len(end) >= rv:
            if end in _GERUNDS_ACUTE:
                w = base[: len(base) - len(end)] + end.translate(_ACUTE)
            elif end in _GERUNDS or base.endswith("uyendo"):
                w = base

    groups = [*_STEP1_DELETE, *_STEP1_IC, "logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"]
    s, done = _longest(w, groups), False  # step 1: standard suffixes
    at = len(w) - len(s)
    if s in _STEP1_DELETE and at >= r2:
        w, done = w[:at], True
    elif s in _STEP1_IC and at >= r2:
        w, done = w[:at], True
        drop_if(["ic"], r2)
    elif s in ("logía", "logías") and at >= r2:
        w, done = w[:at] + "log", True
    elif s in ("ución", "uciones") and at >= r2:
        w, done = w[:at] + "u", True
    elif s in ("encia", "encias") and at >= r2:
        w, done = w[:at] + "ente", True
    elif s == "amente" and at >= r1:
        w, done = w[:at], True
        if drop_if(["iv"], r2):
            drop_if(["at"], r2)
        else:
            drop_if(["os", "ic", "ad"], r2)
    elif s == "mente" and at >= r2:
        w, done = w[:at], True
        drop_if(["ante", "able", "ible"], r2)
    elif s in ("idad", "idades") and at >= r2:
        w, done = w[:at], True
        drop_if(["abil", "ic", "iv"], r2)
    elif s in ("iva", "ivo", "ivas", "ivos") and at >= r2:
        w, done = w[:at], True
        drop_if(["at"], r2)

    if not done:  # step 2: verb suffixes
        s = _longest(w[rv:], _STEP2A)
        if s and w[: len(w) - len(s)].endswith("u"):
            w = w[: len(w) - len(s)]
        else:
            s = _longest(w[rv:], [*_STEP2B, *_STEP2B_GU])
            if s:
                w = w[: len(w) - len(s)]
                if s in _STEP2B_GU and w.endswith("gu"):
                    w = w[:-1]

    s = _longest(w[rv:], [*_STEP3_RV, *_STEP3_E])  # step 3: residual suffix
    if s:
        w = w[: len(w) - len(s)]
        if s in _STEP3_E and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_ACUTE)


def analyse_word(word: str) -> str:
    """Stem, then strip what accents are left."""
    return spanish_stem(word).translate(str.maketrans(ACCENTS, PLAIN))
