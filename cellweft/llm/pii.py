"""Personal data in texts: fixed patterns plus candidates chosen by boosted trees.

DataFrame and MLlib functions only. Base patterns find e-mail addresses, IP
addresses, card and telephone numbers. Generators of high recall propose further,
overlapping spans in forms that the base patterns miss; gradient-boosted trees over
format and context features score them, and a threshold calibrated per kind on held-out
candidates selects those that are added.

Labels: nobody marks personal data in a corpus, so the truth is planted. Fixed forms,
personal and look-alike, are filled with digits and words by hash and set into contexts
taken from the documents; the generators run over these as over any text, and a
candidate is positive if it is a planted personal form of its kind. The base patterns
play no part in labels or features.

Bounded sample: trees see at most `max_candidates` planted contexts (a few places per
document, smallest hash first); finding and scoring covers every text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.llm.common import materialize, table

#: The kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")

#: Fixed patterns. Possessive repeats and look-behinds find the same matches as the
#: plain forms, in time linear in the text, also in long runs of one class.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART, _AT, _DOT = r"[^\s@<>()\[\]{}\",;:\uFF20]", r"\x20?[\[({](?:at|AT|@)[\])}]\x20?", r"\x20?[\[({](?:dot|DOT|\.)[\])}]\x20?"
#: Wider patterns that propose candidates of a kind, of any length.
WIDE = {
    "email": rf"(?<!{_PART}){_PART}++(?:(?:@|\uFF20|{_AT}){_PART}++(?:(?:{_DOT}|\x20dot\x20){_PART}++)*+|\x20at\x20{_PART}++(?:(?:{_DOT}|\x20dot\x20){_PART}++)++)",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}+(?:(?:{_DOT}|\x20dot\x20|\x20?\.\x20?)[0-9]{{1,3}}+){{3}}+(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{3,6}+(?:[\x20./_-]{1,2}+[0-9]{2,6}+){2,4}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\([0-9]{2,5}\)|[0-9]{2,5}+)(?:[\x20./-]{1,2}+[0-9]{2,5}+){1,4}+(?![0-9A-Za-z])",
}
_DIGIT = r"[0-9]"
#: A text without a match of this has neither base spans nor candidates of the kind.
NEEDS = {"email": r"@|\uFF20|[\[({](?:at|AT)[\])}]|\x20at\x20[^\s]++\x20?(?:dot\x20|[\[({](?:dot|DOT|\.)[\])}])", "ip": _DIGIT, "card": _DIGIT, "phone": _DIGIT}
CONTEXT = 24
SPAN = "array<struct<start:int,end:int,found:string,before:string,after:string>>"

#: Forms to plant. 9 is any digit, 8 a number up to 255, 7 one from 256 to
#: 999, W a word of the context, T a top-level domain, L the digit that makes a card
#: number valid, N the one after it; all else stands for itself.
PERSONAL = {
    "email": ("W [at] W.T", "W.W(at)W.T", "W at W dot T", "W [at] W [dot] T", "W99 (at) W.T", "W99\uFF20W.T"),
    "ip": ("8[.]8[.]8[.]8", "99[.]9[.]9[.]99", "8 . 8 . 8 . 8", "8(.)8(.)8(.)8", "8 dot 8 dot 8 dot 8"),
    "card": ("4999.9999.9999.999L", "5999/9999/9999/999L", "4999_9999_9999_999L", "4999  9999  9999  999L", "3999.999999.9999L"),
    "phone": ("(999) 999-9999", "999-999-9999", "999.999.9999", "0999 999 999", "0099 999 999 999"),
}
LOOK_ALIKE = {
    "email": ("W [at] W", "W (at) 99", "W@W", "W@99", "W at W dot W"),
    "ip": ("7.7.9.9", "7.7.99.99", "9.9.7.9", "7 . 99 . 7 . 9", "7[.]9[.]7[.]9"),
    "card": ("4999.9999.9999.999N", "5999/9999/9999/999N", "9999.99.99.9999", "9999-9999-9999", "999_999_999"),
    "phone": ("2099-99-99", "99/99/2099", "99.99.2099", "7.7.99.99", "8.7.99.7", "9999-9999", "99-99", "978-9-999-99999-9", "99 999", "999 999 999.99", "99.99", "99/999"),
}
DOMAINS = ("com", "org", "net", "de", "fr", "io")
#: Top-level domains that count as a sign of an address.
KNOWN_DOMAINS = (*DOMAINS, "edu", "gov", "info", "biz", "eu", "uk", "us", "ch", "nl", "es", "it", "pl", "se", "jp", "cn", "in", "br", "ru")
#: Words that may stand before a planted form.
HINTS = {"email": ("mail", "e-mail:", "contact"), "ip": ("host", "ip:", "server"), "card": ("card", "card no.", "visa"), "phone": ("call", "tel:", "phone")}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of int the combination (a sum, a maximum) of 0 and those before it.

    An aggregate that appends copies its array at each step. So runs of about the square root of
    the length are accumulated alone, then the runs' totals, and both are put together.
    """

    def collected(xs: Column, of: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("before"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(combine(acc["at"], of(x)).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before")))

    def blocks(size: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), size)
        return let(F.transform(starts, lambda i: collected(F.slice(values, i, size), lambda x: x)), lambda done: F.flatten(F.zip_with(done, collected(done, lambda d: d["at"])["before"], lambda d, at: F.transform(d["before"], lambda v: combine(at, v)))))

    return let(F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(16)).cast("int"), blocks)


def _plus(a: Column, b: Column) -> Column:
    return (a + b).cast("int")


def spans(text: Column, pattern: str) -> Column:
    """Start, end (code points, end exclusive), text and context of each match, left to right.

    The pieces between matches and the matches alternate, so places are running
    sums of their lengths, and the context before or after a match is the piece there, with
    the match beyond it if there is room (`CONTEXT` characters in all).
    """
    size = lambda p: F.char_length(p["gap"]) + F.coalesce(F.char_length(p["found"]), F.lit(0))

    def placed(pairs: Column) -> Column:
        def one(p: Column, i: Column, begin: Column) -> Column:
            before = F.concat(F.coalesce(F.get(pairs, i - 1)["found"], F.lit("")), p["gap"])
            after = F.concat(F.coalesce(F.get(pairs, i + 1)["gap"], F.lit("")), F.coalesce(F.get(pairs, i + 1)["found"], F.lit("")))
            start = begin + F.char_length(p["gap"])
            return F.struct(
                start.alias("start"), (start + F.char_length(p["found"])).alias("end"), p["found"].alias("found"),
                F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"),
            )

        begins = running(F.transform(pairs, size), _plus)
        return let(begins, lambda at: F.transform(F.filter(pairs, lambda p: p["found"].isNotNull()), lambda p, i: one(p, i, F.get(at, i))))

    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, b: F.struct(a.alias("gap"), b.alias("found")))
    none = F.expr(f"cast(array() as {SPAN})")
    return F.when(text.rlike(pattern), let(pairs, placed)).otherwise(none)


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn_sum(number: Column) -> Column:
    """Luhn sum of a string of digits, the last one its check digit; other characters count as 0."""
    values = F.transform(F.split(F.reverse(number), ""), lambda d: F.coalesce(F.expr("cast(0 as int)") + F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)))
    terms = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2)))
    return F.aggregate(terms, F.lit(0), lambda a, d: a + d)


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    return luhn_sum(number) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    n = F.char_length(digits(found))
    if kind == "ip":
        return found.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(found))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds _cw_text and, per kind, _cw_base_<kind> (valid matches) and _cw_wide_<kind> (candidates)."""
    out = docs.withColumn("_cw_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    none = F.expr(f"cast(array() as {SPAN})")
    for need in dict.fromkeys(NEEDS.values()):
        out = out.withColumn(f"_cw_need_{list(NEEDS.values()).index(need)}", F.col("_cw_text").rlike(need))
    for kind in KINDS:
        needed = F.col(f"_cw_need_{list(NEEDS.values()).index(NEEDS[kind])}")
        out = out.withColumn(f"_cw_base_{kind}", F.filter(F.when(needed, spans(F.col("_cw_text"), BASE[kind])).otherwise(none), _valid(kind)))
        out = out.withColumn(f"_cw_wide_{kind}", F.when(needed, spans(F.col("_cw_text"), WIDE[kind])).otherwise(none))
    return out


def candidates(rows: DataFrame) -> Column:
    """Array of (kind, start, end, found, before, after) of the candidates of rows from with_spans."""
    return F.flatten(F.array(*[F.transform(f"_cw_wide_{k}", _tagged(k, "found", "before", "after")) for k in KINDS]))


def planted(docs: DataFrame, most: int, places: int = 4) -> DataFrame:
    """Rows order, text, kind, start, end, personal: forms set into contexts of the documents.

    Each document offers `places` places by hash; of all, the `most` with the smallest
    hash are used. Hashes that are too large to be among them are left out before the texts are
    cut, so that some 2 * `most` short contexts are gathered in one task, however many documents there are.
    """
    share = min(1.0, 2.0 * most / max(docs.count() * places, 1))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seed = F.xxhash64(F.col("doc_id").cast("string"), F.char_length(text), "_place")
    spot = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(places))).alias("_place"))
    spot = spot.where(seed <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)).select(seed.alias("order"), F.substring(text, (F.pmod(seed, F.greatest(F.char_length(text) - 80, F.lit(1))) + 1).cast("int"), F.lit(80)).alias("near"))
    spot = spot.orderBy("order", "near").limit(most)
    pick = lambda n, salt: F.pmod(F.xxhash64("order", F.lit(salt)), n).cast("int")
    one_of = lambda xs, salt: F.element_at(F.array(*[F.lit(x) for x in xs]), pick(F.lit(len(xs)), salt) + 1)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    spot = spot.select("order", F.filter(F.split("near", r"\s+"), lambda w: w != "").alias("words"), F.element_at(kinds, pick(F.lit(len(KINDS)), "kind") + 1).alias("kind"), (pick(F.lit(2), "side") == 0).alias("personal"))
    forms, hints = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in KINDS:
        forms = F.when(F.col("kind") == k, F.when(F.col("personal"), one_of(PERSONAL[k], "form")).otherwise(one_of(LOOK_ALIKE[k], "form"))).otherwise(forms)
        hints = F.when(F.col("kind") == k, one_of(HINTS[k], "hint")).otherwise(hints)
    letters = F.coalesce(F.filter(F.transform("words", lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}]", ""))), lambda w: w != ""), F.array().cast("array<string>"))
    spot = spot.withColumns({"form": forms, "hint": hints, "names": F.concat(letters, F.array(F.lit("name")))})

    def fill(c: Column, i: Column) -> Column:
        h = lambda n: F.pmod(F.xxhash64("order", F.lit("fill"), i), n).cast("int")
        return (
            F.when(c == "9", h(F.lit(10)).cast("string"))
            .when(c == "8", h(F.lit(256)).cast("string"))
            .when(c == "7", (h(F.lit(744)) + 256).cast("string"))
            .when(c == "W", F.element_at("names", h(F.size("names")) + 1))
            .when(c == "T", F.element_at(F.array(*[F.lit(x) for x in DOMAINS]), h(F.lit(len(DOMAINS))) + 1))
            .otherwise(c)
        )

    filled = F.array_join(F.transform(F.split("form", ""), fill), "")
    spot = spot.withColumn("filled", filled)
    right = (10 - luhn_sum(F.concat(digits(F.col("filled")), F.lit("0"))) % 10) % 10
    spot = spot.withColumn("filled", F.regexp_replace(F.regexp_replace("filled", "L$", right.cast("string")), "N$", ((right + 1) % 10).cast("string")))
    half = (F.size("words") / 2).cast("int")
    # personal forms often follow a word that announces them, look-alikes seldom
    announced = F.when(pick(F.lit(8), "announced") < F.when(F.col("personal"), 4).otherwise(1), F.concat("hint", F.lit(" "))).otherwise("")
    left = F.concat(F.array_join(F.slice("words", 1, half), " "), F.lit(" "), announced)
    spot = spot.withColumns({"left": left, "right": F.concat(F.lit(" "), F.array_join(F.slice("words", half + 1, F.size("words") - half), " "))})
    return spot.select("order", F.concat("left", "filled", "right").alias("text"), "kind", F.char_length("left").alias("start"), (F.char_length("left") + F.char_length("filled")).alias("end"), "personal")


def features(kind: Column, found: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context of a candidate as numbers."""
    n = F.char_length(found).cast("double")
    count = lambda p: F.regexp_count(found, F.lit(p)).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    d = digits(found)
    return {
        **{f"is_{k}": flag(kind == k) for k in KINDS},
        "length": n,
        "digits": F.char_length(d).cast("double"),
        "letters": count("[A-Za-z]"),
        "groups": count("[0-9]+"),
        "longest_group": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(found, F.lit("[0-9]+"), F.lit(0)), lambda g: F.char_length(g))), F.lit(0)).cast("double"),
        "dots": count(r"\."),
        "blanks": count(r"[\x20()]"),
        "dashes": count("-"),
        "at": count("@"),
        "slashes": count("[/_]"),
        "brackets": count(r"[\[({]"),
        "dot_words": count(r"(?i)\bdot\b"),
        "ends_in_letters": flag(found.rlike(r"(?:\.|dot[\])}]?\x20?)[A-Za-z]{2,6}$")),
        "largest": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(found, F.lit("[0-9]{1,9}"), F.lit(0)), lambda g: g.cast("int"))), F.lit(0)).cast("double"),
        "first_group": F.char_length(F.regexp_extract(found, "[0-9]+", 0)).cast("double"),
        "last_group": F.char_length(F.regexp_extract(found, "([0-9]+)[^0-9]*$", 1)).cast("double"),
        "domain": flag(found.rlike(rf"(?i)(?:\.|dot[\])}}]?\x20?)(?:{'|'.join(KNOWN_DOMAINS)})$")),
        "leading_zero": flag(found.rlike(r"^\(?0")),
        "year": flag(found.rlike(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")),
        "luhn": flag(F.when(F.char_length(d).between(13, 19), luhn(d))),
        "plus_before": flag(before.rlike(r"\+[0-9]{0,3}\x20?$")),
        "digit_before": flag(before.rlike(r"[0-9][\x20.-]?$")),
        "digit_after": flag(after.rlike(r"^[\x20.-]?[0-9]")),
        "letter_after": flag(after.rlike(r"^[A-Za-z]")),
        "hint": flag(F.lower(before).rlike(r"(?:e-?mail|mail|phone|tel|call|fax|card|visa|host|server|ip)[^A-Za-z]{0,6}$")),
        "money": flag(before.rlike(r"[$€£#%]\x20?$")),
    }


def feature_names() -> list[str]:
    nothing = F.lit("")
    return list(features(nothing, nothing, nothing, nothing))


def fit(docs: DataFrame, max_candidates: int = 20_000, precision: float = 0.98) -> tuple[GBTClassificationModel, dict[str, float]] | None:
    """Trees and the threshold of each kind from planted forms, or None where one class is missing (empty table).

    A candidate over a planted form is positive if the form is personal, of its kind and
    met whole, and negative otherwise. A third of the contexts is held out; a kind's threshold is the
    lowest score from which on the held-out candidates reach `precision` (above 1, so
    nothing is added, if none does).
    """
    rows = with_spans(planted(docs, max_candidates).withColumnsRenamed({"kind": "form", "start": "first", "end": "last"}))
    found = rows.select("order", "form", "first", "last", "personal", F.explode(candidates(rows)).alias("c")).where((F.col("c.start") < F.col("last")) & (F.col("first") < F.col("c.end")))
    whole = (F.col("c.kind") == F.col("form")) & (F.abs(F.col("c.start") - F.col("first")) <= 1) & (F.abs(F.col("c.end") - F.col("last")) <= 1)
    f = features(F.col("c.kind"), F.col("c.found"), F.col("c.before"), F.col("c.after"))
    found = found.select("c.kind", (F.col("personal") & whole).cast("double").alias("label"), F.pmod(F.xxhash64("order", F.lit("fold")), F.lit(3)).alias("fold"), *[x.alias(k) for k, x in f.items()])
    sample = materialize(assemble(found).select("kind", "features", "label", "fold"), "pii-sample")
    if sample.where("fold > 0").select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=16, maxDepth=5, maxBins=32, stepSize=0.3, seed=7).fit(sample.where("fold > 0"))
    held = scored(model, sample.where("fold = 0")).withColumn("bin", F.floor(F.col("score") * 100))
    bins = held.groupBy("kind", "bin").agg(F.count("*").alias("n"), F.sum("label").alias("hits")).collect()  # at most 404 rows
    limits = {}
    for kind in KINDS:
        n = hits = 0.0
        limits[kind] = 2.0
        for row in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
            n, hits = n + row["n"], hits + row["hits"]
            if hits >= precision * n:
                limits[kind] = row["bin"] / 100
    return model, limits


def assemble(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=feature_names(), outputCol="features").transform(found)


def scored(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def find_pii(docs: DataFrame, max_candidates: int = 20_000, precision: float = 0.98, keep: list[str] | None = None, into: str = "found") -> DataFrame:
    """`docs` (at least doc_id and text) with an array of (kind, start, end, base) in the column `into`.

    It holds the base spans and those that the trees add (base false, and crossing no base
    span). Null text: empty, nothing found. Each row stands for itself, so doc_id may be
    null or repeat, and equal rows get equal spans. Empty table: empty. Texts of any length are read
    whole, a row at a time, in a time that grows with the text and its matches. A column of `docs` named as `into` is replaced; names that
    begin with _cw_ are taken. `keep`: the columns to carry along, if not all.
    """
    rows = with_spans(docs.drop(into))
    base = F.flatten(F.array(*[F.transform(f"_cw_base_{k}", _tagged(k)) for k in KINDS]))
    names = [c for c in (docs.columns if keep is None else keep) if c != into]
    kept = rows.select(*names, F.monotonically_increasing_id().alias("_cw_row"), base.alias("_cw_base"), candidates(rows).alias("_cw_near"))
    kept = materialize(kept, "pii-spans")
    own = F.transform("_cw_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("base")))
    fitted = fit(docs, max_candidates, precision)
    if fitted is None:
        return kept.select(*names, own.alias(into))
    model, limits = fitted
    found = uncrossed(kept.where(F.size("_cw_near") > 0))
    f = features(F.col("c.kind"), F.col("c.found"), F.col("c.before"), F.col("c.after"))
    found = found.select("row", "c.kind", "c.start", "c.end", *[x.alias(k) for k, x in f.items()])
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(x)) for k, x in limits.items()])
    chosen = scored(model, assemble(found)).where(F.col("score") >= limit)
    added = chosen.groupBy(F.col("row").alias("_cw_row")).agg(F.collect_list(F.struct("kind", "start", "end", F.lit(False).alias("base"))).alias("_cw_added"))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,base:boolean>>)")
    return kept.join(added, "_cw_row", "left").select(*names, F.concat(own, F.coalesce("_cw_added", none)).alias(into))


def uncrossed(kept: DataFrame) -> DataFrame:
    """Rows row, c of the candidates that no base span of their text crosses; those that one does are known already.

    Spans of a text that has both are sorted by their start: a candidate is crossed if a base
    span before it ends beyond its start, or the next one begins before its end.
    """
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    alone = kept.where(F.size("_cw_base") == 0).select(F.col("_cw_row").alias("row"), F.explode("_cw_near").alias("c"))
    both = kept.where(F.size("_cw_base") > 0)
    near = both.select(F.col("_cw_row").alias("row"), F.explode("_cw_near").alias("c")).select("row", "c", F.col("c.start").alias("start"), F.col("c.end").alias("end"))
    base = both.select(F.col("_cw_row").alias("row"), F.explode(F.coalesce("_cw_base", none)).alias("b")).select("row", F.col("b.start").alias("start"), F.col("b.end").alias("end"))
    placed = near.unionByName(base, allowMissingColumns=True)
    is_base = F.col("c").isNull()
    order = Window.partitionBy("row").orderBy("start", F.when(is_base, 0).otherwise(1), "end")
    reach = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first(F.when(is_base, F.col("start")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (following.isNull() | (following >= F.col("end")))
    return alone.unionByName(placed.withColumn("_free", free).where(F.col("_free") & F.col("c").isNotNull()).select("row", "c"))


def without_spans(text: Column, found: Column, size: int = 8192) -> Column:
    """`text` with each span (kind, start, end) of the array `found` replaced by its kind in brackets; spans that cross go together, under the kind of the first.

    Pieces are cut out of stretches of `size` characters, as finding a place in a text costs what is before it.
    """
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    stretches = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.char_length(text) - 1, F.lit(0)) / size).cast("int")), lambda k: F.substring(text, k * size + 1, F.lit(size)))

    def piece(cut: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / size).cast("int"), F.floor(F.greatest(end - 1, start) / size).cast("int")
        parts = F.transform(F.sequence(first, last), lambda k: F.substring(F.coalesce(F.get(cut, k), F.lit("")), F.greatest(start - k * size, F.lit(0)) + 1, F.least(end - k * size, F.lit(size)) - F.greatest(start - k * size, F.lit(0))))
        return F.when(end > start, F.array_join(parts, "")).otherwise("")

    def done(spans_: Column, cut: Column) -> Column:
        ends = F.transform(spans_, lambda s: -s["back"])
        # the furthest end before each span: where it begins before that, it goes with an earlier one
        pieces = let(running(ends, F.greatest), lambda reach: F.transform(spans_, lambda s, i: F.when(s["start"] >= F.get(reach, i), F.concat(piece(cut, F.get(reach, i), s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")))
        return F.concat(F.array_join(pieces, ""), piece(cut, F.array_max(ends), F.char_length(text)))

    return let(order, lambda spans_: let(stretches, lambda cut: done(spans_, cut)))


def redact(docs: DataFrame, **options) -> DataFrame:
    """`docs` with each found span of the text replaced by its kind in brackets.

    Spans that cross are replaced together, under the kind of the first. Null texts
    stay null; all other columns, whatever their names, stay as they are. Time grows with
    the text and its spans also in very long texts full of numbers.
    """
    out = find_pii(docs, into="_cw_found", **options)
    return out.withColumn("text", F.when(F.size("_cw_found") > 0, without_spans(F.col("text"), F.col("_cw_found"))).otherwise(F.col("text"))).drop("_cw_found")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _valid(kind: str) -> Callable[[Column], Column]:
    return lambda s: valid(kind, s["found"])


def _name(label: Column) -> Callable[[Column], Column]:
    return lambda s: F.concat(label, s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))


def _tagged(kind: str, *more: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), *[s[x].alias(x) for x in ("start", "end", *more)])


def _listed(found: Column) -> Column:
    """kind:start:end of spans by kind as listed, then start, comma-joined."""
    parts = []
    for kind in KINDS:
        some = F.array_sort(F.transform(F.filter(found, _is(kind)), lambda s: F.struct(s["start"], s["end"])))
        label = F.lit(f"{kind}:")
        parts.append(F.transform(some, _name(label)))
    return F.array_join(F.flatten(F.array(*parts)), ",")


def op5_pii(spark, sf_dir):
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("found", lambda s: s["base"])
    n = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *n, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))
