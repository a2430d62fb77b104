"""Secrets in texts: fixed patterns, and tokens that pass a battery of randomness tests.

The battery scores how well a token fits a uniform draw from the alphabet of its
inferred encoding: chi-squared uniformity of its characters, a runs test about the
middle of the alphabet, and serial correlation of neighbours, combined by Fisher's
method. How high ordinary words of the same length score is known from a model of
runs of letters with their natural frequencies, and from the natural tokens (letters
only, one case or capitalised) of the same length class where there are any. Against
the higher of both each candidate gets a p-value, and Benjamini-Hochberg per length
class selects those that are added.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import materialize, table

KINDS = ("assign", "access", "hex")
#: Fixed patterns and least lengths.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
NATURAL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Encodings from narrow to wide; a token is of the first whose alphabet holds it.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
_INDEX = {k: {c: i for i, c in enumerate(v)} for k, v in ENCODINGS.items()}
#: Scores are kept in this many steps of log10, from 1 down to 10**-12.
STEPS = 240
#: Natural frequencies of the letters a to z, per 1000.
LETTERS = np.array([82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 7.7, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 9.8, 24, 1.5, 20, 0.7])
#: Exponents of the frequencies that the model draws with, from natural to uniform, and draws with each.
TILTS, DRAWS = (1.0, 0.75, 0.5, 0.25, 0.0), 400
#: Longer runs count as of this length, which is on the safe side: they look less random.
LONGEST = 256


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(token: str) -> float:
    """Fisher's combined p-value that a token is a uniform draw; 0 where no encoding holds it."""
    body = token.rstrip("=")
    name = next((k for k, s in _SETS.items() if s.issuperset(body)), None)
    if name is None or len(body) < 8:
        return 0.0
    k, index = len(ENCODINGS[name]), _INDEX[name]
    x = np.array([index[c] for c in body], float)
    n = len(x)
    count = np.bincount(x.astype(int), minlength=k)
    chi, free = float(((count - n / k) ** 2).sum() * k / n), k - 1
    z = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))  # Wilson-Hilferty
    p_chi = 0.5 * math.erfc(z / math.sqrt(2))
    high = x >= k / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        p_runs = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
        p_side = _normal_tail((a - n / 2) / math.sqrt(n / 4))
    else:
        p_runs, p_side = 0.0, 2.0 ** (1 - n)
    d = x - x.mean()
    r = float((d[1:] * d[:-1]).sum() / (d * d).sum()) if (d * d).sum() > 0 else 1.0
    p_serial = _normal_tail((r + 1 / n) * math.sqrt(n))
    # letters of a natural word fill few of the digits and cases of their alphabet
    groups = [len(g) for g in (re.findall("[0-9]", ENCODINGS[name]), re.findall("[a-z]", ENCODINGS[name]), re.findall("[A-Z]", ENCODINGS[name])) if g]
    seen = [len(re.findall(p, body)) for p in ("[0-9]", "[a-z]", "[A-Z]") if re.search(p, ENCODINGS[name])]
    mix = sum((s - n * g / k) ** 2 / (n * g / k) for s, g in zip(seen, groups, strict=True))
    p_mix = math.exp(-mix / 2)  # chi-squared tail with two degrees, an upper bound with fewer
    stat = -2 * sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_side, p_serial, p_mix))
    half, term, total = stat / 2, 1.0, 1.0
    for i in range(1, 5):
        term *= half / i
        total += term
    return math.exp(-half) * total


def length_class(n: int) -> int:
    """Half octaves of length."""
    return int(2 * math.log2(n))


def score_step(p: float) -> int:
    """The bin of a score; 0 holds the highest."""
    return min(int(-20 * math.log10(max(p, 1e-12))), STEPS - 1)


@lru_cache(maxsize=None)
def natural_tail(size: int) -> np.ndarray:
    """For each step, the chance that a natural run of a length class scores as high or higher.

    Runs are letters drawn one by one with their frequencies, in lower case, in upper
    case and capitalised; the highest chance of the three counts, at the shortest length
    of the class. Draws come from several tilted frequencies and are weighted back
    (importance sampling), so that chances far below one in all draws are known too.
    """
    n = next(n for n in range(20, LONGEST + 1) if n == LONGEST or length_class(n) >= size)
    rng = np.random.default_rng(size)
    tilted = np.array([LETTERS**t / (LETTERS**t).sum() for t in TILTS])
    x = np.concatenate([rng.choice(26, (DRAWS, n), p=q) for q in tilted])
    logs = np.log(tilted)[:, x].sum(axis=2)
    weight = np.exp(logs[0] - logs.max(axis=0)) / np.exp(logs - logs.max(axis=0)).mean(axis=0) / len(x)
    low = ["".join(map(chr, row)) for row in (x + ord("a")).tolist()]
    tails = [np.cumsum(np.bincount([score_step(randomness(form(t))) for t in low], weight, STEPS)) for form in (str, str.upper, str.capitalize)]
    return np.minimum(np.max(tails, axis=0), 1)


def step_limits(bins: list[tuple[int, int, int, int]], rate: float) -> dict[int, int]:
    """The last step that is added, by length class, from rows (class, step, natural tokens, other tokens)."""
    out = {}
    for size in sorted({b[0] for b in bins}):
        natural, other = np.zeros(STEPS), np.zeros(STEPS)
        for _, step, a, b in (b for b in bins if b[0] == size):
            natural[step], other[step] = a, b
        seen = np.cumsum(natural)
        p = np.maximum(natural_tail(size), np.where(seen > 0, (1 + seen) / (1 + natural.sum()), 0))
        ok = np.flatnonzero((p <= rate * np.cumsum(other) / max(other.sum(), 1)) & (natural + other > 0))
        if len(ok):
            out[size] = int(ok[-1])
    return out


def find_base(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        base, tokens = [], []
        for text in pdf["text"]:
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in find_base(text)])
            some = []
            for m in CANDIDATE.finditer(text):
                step = score_step(randomness(m.group()))
                some.append({"start": m.start(), "end": m.end(), "size": length_class(m.end() - m.start()), "step": step, "natural": bool(NATURAL.fullmatch(m.group()))})
            tokens.append(some)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "base": base, "tokens": tokens})


SPAN = "struct<kind:string,start:int,end:int>"


def find_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, base and added (arrays of kind, start, end).

    Places are code points, end exclusive. base: valid matches of the fixed patterns;
    added: tokens that the battery selects (kind random) and that no base span
    crosses. Null text: empty. Repeated rows each give a row; null doc_id is kept.

    A score's p-value in its length class is the chance that the model of natural runs
    scores as high, or (1 + natural tokens that score as high) / (1 + natural tokens)
    where there are such tokens and that is more. Scores are binned, so that classes and
    bins are all that is gathered; a bin is judged by its lower end, which is on the safe side.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    token = "struct<start:int,end:int,size:int,step:int,natural:boolean>"
    found = materialize(rows.mapInPandas(_scan, f"doc_id long, base array<{SPAN}>, tokens array<{token}>"), "secrets")
    bins = found.select(F.explode("tokens").alias("t")).groupBy("t.size", "t.step").agg(F.count(F.when(F.col("t.natural"), 1)).alias("natural"), F.count(F.when(~F.col("t.natural"), 1)).alias("other"))
    chosen = step_limits([tuple(map(int, b)) for b in bins.collect()], rate)  # at most STEPS rows per length class, of which there are at most 62
    crossed = lambda s: F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    if not chosen:
        added = F.expr(f"cast(array() as array<{SPAN}>)")
    else:
        table_ = F.create_map(*[F.lit(x) for kv in chosen.items() for x in kv])
        picked = F.filter("tokens", lambda t: ~t["natural"] & (t["step"] <= F.coalesce(F.try_element_at(table_, t["size"]), F.lit(-1))) & ~crossed(t))
        added = F.transform(picked, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return found.select("doc_id", "base", added.alias("added"))


def _listed(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, "random")) for x in (k, i)])
    placed = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("place"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(placed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op9_secret_scan(spark, sf_dir):
    out = find_secrets(table(spark, sf_dir, "documents"))
    n = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *n, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"))
