"""Porter's suffix stripping (1980, with its later published points) as column expressions over a table of terms."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the algorithm: suffixes and what they become.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

#: A run of consonants and a run of vowels; y is a consonant at a word's start (written Y here) and after a vowel.
_CONSONANTS, _VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_MEASURED = f"^({_CONSONANTS})?{_VOWELS}{_CONSONANTS}"
_TWICE = f"{_MEASURED}{_VOWELS}{_CONSONANTS}"
_ONCE = f"{_MEASURED}({_VOWELS})?$"
_HAS_VOWEL = f"^({_CONSONANTS})?[aeiouy]"
_SHORT = f"^{_CONSONANTS}[aeiouy][^aeiouwxy]$"


def _swapped(terms: DataFrame, table: dict[str, str]) -> DataFrame:
    """The longest suffix of the table is exchanged where what stands before it has a measure."""
    pattern = f"^(.+?)({'|'.join(table)})$"
    suffix = F.regexp_extract("_w", pattern, 2)
    cut = terms.withColumn("_suffix", suffix).withColumn("_stem", F.expr("substring(_w, 1, length(_w) - length(_suffix))"))
    new: Column | None = None
    for old, other in table.items():
        hit = F.col("_suffix") == old
        new = F.when(hit, other) if new is None else new.when(hit, other)
    return cut.withColumn("_w", F.when((F.col("_suffix") != "") & F.col("_stem").rlike(_MEASURED), F.concat("_stem", new)).otherwise(F.col("_w")))


def _inflections_cut(terms: DataFrame) -> DataFrame:
    """Plurals, -eed, -ed and -ing."""
    w = F.col("_w")
    plural = F.when(w.rlike("^.+(ss|i)es$"), F.expr("left(_w, length(_w) - 2)")).when(w.rlike("^.+[^s]s$"), F.expr("left(_w, length(_w) - 1)")).otherwise(w)
    terms = terms.withColumn("_w", plural).withColumn("_stem", F.regexp_extract("_w", "^(.+?)(eed|ed|ing)$", 1)).withColumn("_suffix", F.regexp_extract("_w", "^(.+?)(eed|ed|ing)$", 2))
    stem, cut = F.col("_stem"), (F.col("_suffix") != "eed") & (F.col("_suffix") != "") & F.col("_stem").rlike(_HAS_VOWEL)
    doubled = stem.rlike("[^aeiouylsz]$") & (F.expr("right(_stem, 1)") == F.expr("substring(_stem, -2, 1)")) & (F.length(stem) > 1)
    mended = F.when(stem.rlike("(at|bl|iz)$") | (~doubled & stem.rlike(_SHORT)), F.concat(stem, F.lit("e"))).when(doubled, F.expr("left(_stem, length(_stem) - 1)")).otherwise(stem)
    return terms.withColumn("_w", F.when((F.col("_suffix") == "eed") & stem.rlike(_MEASURED), F.concat(stem, F.lit("ee"))).when(cut, mended).otherwise(w))


def _ends_cut(terms: DataFrame) -> DataFrame:
    """Suffixes that go after two measures, a last e, and a double l."""
    pattern = f"^(.+?)({'|'.join(STEP_4)})$"
    ion = F.regexp_extract("_w", "^(.+?[st])ion$", 1)
    plain = F.regexp_extract("_w", pattern, 1)
    stem = F.when(plain != "", plain).when(ion != "", ion).otherwise("")
    terms = terms.withColumn("_stem", stem).withColumn("_w", F.when((F.col("_stem") != "") & F.col("_stem").rlike(_TWICE), F.col("_stem")).otherwise(F.col("_w")))
    without_e = F.regexp_extract("_w", "^(.+?)e$", 1)
    gone = (without_e != "") & (without_e.rlike(_TWICE) | (without_e.rlike(_ONCE) & ~without_e.rlike(_SHORT)))
    terms = terms.withColumn("_w", F.when(gone, without_e).otherwise(F.col("_w")))
    return terms.withColumn("_w", F.when(F.col("_w").rlike("ll$") & F.col("_w").rlike(_TWICE), F.expr("left(_w, length(_w) - 1)")).otherwise(F.col("_w")))


def stemmed(terms: DataFrame, term_column: str = "term") -> DataFrame:
    """``terms`` with a column ``stem``.

    For tables of distinct terms: each is worked on once, by built-in
    expressions.  Terms of one or two signs, of over 64, and null ones, are
    their own stems.  A table that holds columns named ``stem`` or with a
    leading ``_w``, ``_stem`` or ``_suffix`` is refused.
    """
    clash = {"stem", "_w", "_stem", "_suffix"} & {c.lower() for c in terms.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are used for stemming")
    term = F.col(term_column)
    out = _inflections_cut(terms.withColumn("_w", F.regexp_replace(term, "^y", "Y")))
    out = out.withColumn("_w", F.when(F.col("_w").rlike("^.+y$") & F.regexp_replace("_w", "y$", "").rlike(_HAS_VOWEL), F.regexp_replace("_w", "y$", "i")).otherwise(F.col("_w")))
    out = _ends_cut(_swapped(_swapped(out, STEP_2), STEP_3))
    return out.withColumn("stem", F.when(F.length(term).between(3, 64), F.regexp_replace("_w", "^Y", "y")).otherwise(term)).drop("_w", "_stem", "_suffix")
