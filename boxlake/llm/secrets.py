"""Secret scans, in DataFrame functions only: fixed patterns, and character Markov models for strings without a telling context.

Two first-order character chains, of random strings and of ordinary identifiers, are counted over a bounded sample of
documents that the fixed patterns label; a long token is a secret if its log-likelihood ratio per transition is high.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in their order, their patterns, and the characters that a match needs at least.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA)([A-Z0-9]{16,})"  # the shorter runs fail anyway
HEX = r"()([0-9a-f]{24,})"
LEAST = {"assign": 6, "access": 20, "hex": 24}
# A cheap necessary condition of a match that is long enough.
SIGNS = {"assign": r"(?i:passw|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
TOKEN = r"()([A-Za-z0-9+/_-]{20,})"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
MASK = "[SECRET]"


def spans_of(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans (code points, end exclusive) of the leftmost matches for which keep(match, value) holds: cut the text at the matches and add lengths up."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(whole), F.lit(0)))
    none = F.array().cast(SPAN)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))).cast(SPAN)
        return F.struct(end.alias("at"), F.when(keep(x["whole"], x["value"]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns; kinds may overlap each other."""
    none = F.array().cast(SPAN)
    found = []
    for kind, pattern in enumerate((ASSIGN, ACCESS, HEX)):
        name = KINDS[kind]
        least = LEAST[name]
        keep = (lambda m, v, n=least: F.length(v) >= n) if name == "assign" else (lambda m, v, n=least: F.length(m) >= n)
        found.append(F.when(text.rlike(SIGNS[name]), spans_of(text, pattern, kind, keep)).otherwise(none))
    return F.concat(*found)


def train_ratio(docs: DataFrame, sample_docs: int = 4000) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of every pair of characters, row by row of ALPHABET.

    Labelled samples: random strings are the values of the fixed patterns and, as those know few alphabets, the digests of
    the documents in the usual spellings (Base64 with and without its two signs, upper-case hexadecimal); ordinary identifiers are the other
    words, alone and joined to compounds. They come from about ``sample_docs`` documents chosen by the hash of doc_id and text (a
    bound on training only). Without documents both chains are uniform, and no ratio is over 0.
    """
    every = max(1, docs.count() // sample_docs)
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).withColumn("spans", base_spans(F.col("text")))
    digest = F.sha2(F.concat_ws(":", "doc_id", F.xxhash64("text")), 256)
    spelled = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    digests = F.array(spelled, F.regexp_replace(spelled, "[+/]", ""), F.translate(spelled, "+/", "-_"), F.upper(digest))
    secret = chosen.select(F.explode(F.concat("spans.value", digests)).alias("word"), F.lit(1).alias("random"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), r"AKIA[A-Z0-9]{16,}", " "), r"[0-9a-f]{24,}", " ")
    ordinary = chosen.select(F.explode(F.regexp_extract_all(rest, F.lit(r"([A-Za-z0-9+/_-]{3,})"), F.lit(1))).alias("word"), F.lit(0).alias("random"))
    joined = ordinary.select(F.concat_ws("_", "word", "word").alias("word"), "random").unionByName(ordinary.select(F.concat("word", F.initcap("word"), F.lit("-"), "word").alias("word"), "random"))
    words = secret.unionByName(ordinary).unionByName(joined).groupBy("random", "word").agg(F.count("*").alias("n"))
    at = F.explode(F.when(F.length("word") > 1, F.sequence(F.lit(1), F.length("word") - 1)))
    pairs = words.select("random", "n", "word", at.alias("i")).select("random", "n", F.expr("substring(word, i, 2)").alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect()}
    k = len(ALPHABET)
    out = []
    for a in ALPHABET:
        row = [[counts.get((label, a + b), 0) for b in ALPHABET] for label in (0, 1)]
        for b in range(k):
            chance = [(row[label][b] + weight / k) / (sum(row[label]) + weight) for label, weight in ((0, 2.0), (1, 40.0))]
            out.append(round(math.log((chance[1] + 1 / k) / 2 / chance[0]), 5))
    return out


def markov_spans(text: Column, base: Column, ratio: list[float], least: float) -> Column:
    """Long tokens apart from all base spans whose mean ratio per transition reaches ``least``."""
    none = F.array().cast(SPAN)
    weights = F.split(F.lit(",".join(map(str, ratio))), ",").cast("array<double>")

    def place(value: Column, i: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1)))

    def mean(value: Column) -> Column:
        step = lambda acc, i: acc + F.element_at(weights, ((place(value, i) - 1) * len(ALPHABET) + place(value, i + 1)).cast("int"))
        return F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0), step) / (F.length(value) - 1)

    candidates = F.when(text.rlike(TOKEN), spans_of(text, TOKEN, KINDS.index("markov"), lambda m, v: F.lit(True))).otherwise(none)
    apart = F.filter(candidates, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return F.filter(apart, lambda c: c["value"].rlike("[A-Za-z]") & (mean(c["value"]) >= least))


def scan_secrets(docs: DataFrame, ratio: list[float] | None = None, least: float = 0.8, base: str = "base", secrets: str = "secrets") -> DataFrame:
    """docs with the columns named ``base`` and ``secrets``: arrays of (start, kind, end, value) sorted by start, then kind, of whole texts.

    Null text counts as empty; repeated rows keep a row each; an empty table gives no rows; other columns stay.
    """
    ratio = train_ratio(docs) if ratio is None else ratio
    text = F.coalesce(F.col("text"), F.lit(""))
    based = docs.withColumn(base, base_spans(text))
    return based.withColumn(secrets, F.array_sort(F.concat(base, markov_spans(text, F.col(base), ratio, least)))).withColumn(base, F.array_sort(base))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    scanned = scan_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *map(count, KINDS[:3]), F.sha2(listed("base"), 256).alias("base_sha256"), listed("secrets").alias("spans"))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret's span replaced by a mask; all rows and columns stay, n_chars (if there) follows the text; null text stays null."""
    scanned = scan_secrets(docs, base="__base", secrets="__secrets")

    def cut(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("__secrets", start, cut, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    out = scanned.withColumn("text", F.when(F.size("__secrets") > 0, masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
