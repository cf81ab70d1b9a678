"""Words and their stems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}_]+"


def word_list(text: Column) -> Column:
    """The words of a text in lower case; none in null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def weak_stem(word: Column) -> Column:
    """Harman's S-stemmer: plural endings of words of four letters and more; the first rule whose ending fits decides."""
    n = F.char_length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    plural = F.when(F.endswith(word, F.lit("ies")), F.when(~F.rlike(word, F.lit("[ea]ies$")), F.concat(cut(3), F.lit("y"))).otherwise(word))
    plural = plural.when(F.endswith(word, F.lit("es")), F.when(~F.rlike(word, F.lit("[aeo]es$")), cut(1)).otherwise(word))
    plural = plural.when(F.endswith(word, F.lit("s")), F.when(~F.rlike(word, F.lit("[us]s$")), cut(1)).otherwise(word))
    return F.when(n >= 4, F.coalesce(plural, word)).otherwise(word)


#: The same rules in SQL, of a column ``w``.
WEAK_STEM_SQL = """CASE WHEN length(w) < 4 THEN w
  WHEN w LIKE '%ies' THEN CASE WHEN regexp_matches(w, '[ea]ies$') THEN w ELSE substr(w, 1, length(w) - 3) || 'y' END
  WHEN w LIKE '%es' THEN CASE WHEN regexp_matches(w, '[aeo]es$') THEN w ELSE substr(w, 1, length(w) - 1) END
  WHEN w LIKE '%s' THEN CASE WHEN regexp_matches(w, '[us]s$') THEN w ELSE substr(w, 1, length(w) - 1) END ELSE w END"""
