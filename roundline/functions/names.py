"""Comparison of names that were read with errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: misreadings of the name "null"
NULL_NAMES = ("null", "nul", "nuli", "nu11", "nu1l", "nill", "mull", "nu", "jyu", "nuii")


def normal(name: Column) -> Column:
    return F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit(""))


def stripped(name: Column) -> Column:
    """Lower-case Latin letters, digits and Hangul syllables only."""
    return F.regexp_replace(F.lower(name), "[^0-9a-z가-힣]", "")


def core(name: Column) -> Column:
    """Longest run of kept characters; after stripping there is one run only, and
    a single character is kept as it is."""
    return stripped(name)


def is_null_name(normal_name: Column) -> Column:
    return normal_name.isin(*NULL_NAMES)


def is_null_text(text: Column) -> Column:
    """A misreading of "null", or one edit away from it in five characters at most."""
    n = F.regexp_replace(normal(text), "[^0-9a-z]", "")
    return (n != "") & (n.isin(*NULL_NAMES) | ((F.length(n) <= 5) & (F.levenshtein(n, F.lit("null")) <= 1)))


def canonical(text: Column) -> Column:
    return F.when(is_null_text(text), "null").otherwise(F.trim(text))


def _contains(a: Column, b: Column, least: int) -> Column:
    """The shorter one, of ``least`` characters or more, is part of the longer one."""
    return (F.least(F.length(a), F.length(b)) >= least) & (F.when(F.length(a) <= F.length(b), b.contains(a)).otherwise(a.contains(b)))


def _match(a: Column, b: Column, sa: Column, sb: Column) -> Column:
    shortest = F.least(F.length(a), F.length(b))
    allowed = F.when(shortest <= 3, 1).when(shortest >= 6, 3).otherwise(2)
    same = (is_null_name(a) & is_null_name(b)) | ((sa != "") & (sb != "") & ((sa == sb) | _contains(sa, sb, 4)))
    return (a != "") & (b != "") & (same | F.levenshtein(a, b, 3).between(0, allowed))


def names_match(a: Column, b: Column) -> Column:
    """Whether two normalised names are the same but for reading errors."""
    return _match(a, b, stripped(a), stripped(b))


def normal_match(na: Column, nb: Column, ca: Column, cb: Column) -> Column:
    """``texts_match`` for normal and kept forms made beforehand."""
    return _match(na, nb, ca, cb)


def forms_match(na: Column, nb: Column, ca: Column, cb: Column) -> Column:
    """Whether normal forms, or the kept parts, are one name; for forms made beforehand."""
    parts = (ca != "") & (cb != "") & ((ca == cb) | _contains(ca, cb, 4) | _match(ca, cb, ca, cb))
    return _match(na, nb, ca, cb) | parts


def texts_match(a: Column, b: Column) -> Column:
    return names_match(normal(a), normal(b))


def _let(a: Column, b: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over both names with their normal and kept forms, made once."""
    forms = F.struct(a.alias("a"), b.alias("b"), normal(a).alias("na"), normal(b).alias("nb"), core(a).alias("ca"), core(b).alias("cb"))
    return F.get(F.transform(F.array(forms), body), F.lit(0))


def _texts(x: Column) -> Column:
    return _match(x["na"], x["nb"], x["ca"], x["cb"])


def _cores(x: Column) -> Column:
    a, b, ca, cb = x["a"], x["b"], x["ca"], x["cb"]
    near = (ca == cb) | _contains(ca, cb, 4) | ((F.least(F.length(ca), F.length(cb)) >= 2) & _match(ca, cb, ca, cb))
    return (a != "") & (b != "") & (_texts(x) | ((ca != "") & (cb != "") & near))


def _score(x: Column) -> Column:
    na, nb = x["na"], x["nb"]
    longest = F.greatest(F.length(na), F.length(nb))
    close = F.when(na == nb, F.lit(1.0)).when(longest > 0, F.greatest(F.lit(0.0), 1.0 - F.levenshtein(na, nb) / longest)).otherwise(F.lit(0.0))
    la, lb = F.length(x["ca"]), F.length(x["cb"])
    by_core = F.when((la > 0) & (lb > 0), 0.82 + 0.18 * (F.least(la, lb) / F.greatest(la, lb))).otherwise(F.lit(0.0))
    return F.when((x["a"] == "") | (x["b"] == ""), 0.0).when(_texts(x), close).when(_cores(x), by_core).otherwise(0.0)


def cores_match(a: Column, b: Column) -> Column:
    """Whether the kept parts are the same, one in the other, or match as names."""
    return _let(a, b, _cores)


def match_score(a: Column, b: Column) -> Column:
    """1 for equal names, 1 - distance / length for matches, at least 0.82 for
    matching cores, else 0."""
    return _let(a, b, _score)


def pair_match(a: Column, b: Column, na: Column, nb: Column, ca: Column, cb: Column) -> tuple[Column, Column, Column]:
    """``texts_match``, ``cores_match`` and ``match_score`` for forms made beforehand."""
    x = {"a": a, "b": b, "na": na, "nb": nb, "ca": ca, "cb": cb}
    return _texts(x), _cores(x), _score(x)


def header_base(text: Column) -> Column:
    head = F.split(F.replace(text, F.lit(" "), F.lit("")), r"\(")[0]
    return F.regexp_replace(head, "[^가-힣a-zA-Z]", "")


def is_header(text: Column, word: str = "스카우터", latin: str = "scouter") -> Column:
    """Header line: holds the Latin word, or is two edits or fewer from the other."""
    base = header_base(text)
    return (base != "") & (F.lower(base).contains(latin) | (F.levenshtein(base, F.lit(word)) <= 2))


def is_second_header(text: Column) -> Column:
    head = F.split(F.replace(text, F.lit(" "), F.lit("")), r"\(")[0]
    return head.rlike("[2zZ²]")


def is_header_fragment(text: Column) -> Column:
    t = F.replace(F.trim(text), F.lit(" "), F.lit(""))
    return (t == "") | is_header(t) | t.rlike(r"^[\{\[\(]?[lL1Iİ|]+[\}\]\)]?$") | t.rlike(r"^[(){}\[\]|]+$")


def is_noise(text: Column) -> Column:
    """Scoreboard texts that are no names."""
    compact = F.replace(F.trim(text), F.lit(" "), F.lit(""))
    words = "clan|match|mission|redtea|bluete|kill|death|head|nick|닉|킬|데스|헤드|승리|패배|win|lose"
    return is_header_fragment(text) | F.lower(compact).rlike(words) | compact.rlike(r"^[\d\s/.]+$") | (F.length(compact) <= 1)


def first_integer(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).try_cast("bigint")
