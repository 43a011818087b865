"""Secret scan: three patterns, and windows of high Shannon entropy over candidate strings.

A candidate is a long run of key-like characters with a digit. A window slides over it; the counts
of the characters of its class are carried from step to step and with them the window's entropy.
Hexadecimal windows of either case have a lower threshold. Candidates are first cut at allow-list
matches and at spans of the three patterns; what lies outside is scanned for itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns: kind, pattern, group whose length counts, least length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]+)", 1, 24),
)
# A faster search for the same runs of at least 24: a run is always matched whole.
HEX_RUNS = r"([0-9a-f]{24,})"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
PARTS = "array<struct<start:bigint,word:string>>"
HEXADECIMAL = {"hex": "[0-9A-Fa-f]", "digits": "[0-9]", "alpha": "[A-Za-z]"}
# Character classes: alphabet and entropy in bits from which a window counts.
CLASSES = {
    "hex": ("0123456789abcdef", 3.0),
    "key": ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 3.7),
}
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|x{6}|0{6}|1234567|abcdefg"
# One entry of the list, long runs of one letter whole and without stepping back.
ENTRY = r"(?i)example|sample|dummy|placeholder|changeme|x{6,}+|0{6,}+|1234567|abcdefg"
# An entry takes up to so many letters and digits on both sides along, so that a token that is hardly
# longer than a window is told by it; it never reaches beyond a separator.
BESIDE = 3
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def _spans(text: Column, pattern: str, measure: Column, least: int, kind: str, rank: int) -> Column:
    """Spans of all matches in code points: gaps between matches and matches themselves, summed up."""
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.length(s).cast("bigint"))
    zipped = F.arrays_zip(
        gaps.alias("gap"), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s: F.length(s).cast("bigint")).alias("own"),
        F.transform(measure, F.length).alias("size"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), _none().alias("found"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + F.coalesce(m["own"], F.lit(0).cast("bigint"))
        span = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))).cast(SPAN)
        good = F.coalesce(m["size"] >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(zipped, start, step, lambda acc: acc["found"])


def _entropy_span(word: Column) -> Column:
    """``struct(first, last)`` code points of the windows of high entropy in a candidate; NULL if none.

    State: counts per character of the class, the sum of ``c log2 c``, the windows found so far, and
    the places after the last character that is not hexadecimal, not a digit, not a letter. A window
    of hexadecimal digits and letters alone counts from the class's bits in any candidate.
    """
    letters = F.split(word, "")

    def scan(alphabet: str, bits: float, hex_bits: float) -> Column:
        index = lambda ch: F.instr(F.lit(alphabet), ch) - 1
        weigh = lambda c: F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(0.0)
        zero = F.struct(
            F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"),
            F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
            *[F.lit(0).alias(name) for name in HEXADECIMAL],
        )

        def step(acc: Column, i: Column) -> Column:
            enters = index_at(i)
            leaves = F.when(i >= WINDOW, index_at(i - WINDOW)).otherwise(F.lit(-1))
            changed = F.transform(
                acc["counts"],
                lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0),
            )
            before_in, before_out = F.get(acc["counts"], enters), F.when(leaves >= 0, F.get(acc["counts"], F.greatest(leaves, F.lit(0))))
            delta = F.when(enters == leaves, 0.0).otherwise(
                weigh(before_in + 1) - weigh(before_in)
                + F.coalesce(weigh(before_out - 1) - weigh(before_out), F.lit(0.0))
            )
            total = acc["sum"] + delta
            letter = F.get(letters, i)
            since = {name: F.when(letter.rlike(pattern), acc[name]).otherwise(i + 1) for name, pattern in HEXADECIMAL.items()}
            begin = i - (WINDOW - 1)
            mixed = (since["hex"] <= begin) & (since["digits"] > begin) & (since["alpha"] > begin)
            entropy = F.lit(math.log2(WINDOW)) - total / WINDOW
            high = (i >= WINDOW - 1) & ((entropy >= bits) | (mixed & (entropy >= hex_bits)))
            return F.struct(
                changed.alias("counts"), total.alias("sum"),
                F.coalesce(acc["first"], F.when(high, i - (WINDOW - 1))).alias("first"),
                F.when(high, i + 1).otherwise(acc["last"]).alias("last"),
                *[c.alias(name) for name, c in since.items()],
            )

        index_at = lambda i: index(F.get(letters, i))
        return F.aggregate(F.sequence(F.lit(0), F.length(word) - 1), zero, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    hex_bits = CLASSES["hex"][1]
    return F.when(word.rlike("^[0-9a-f]+$"), scan(*CLASSES["hex"], hex_bits)).otherwise(scan(*CLASSES["key"], hex_bits))


def _outside(start: Column, word: Column, spans: Column) -> Column:
    """``(start, word)`` of the parts of a candidate outside ``spans``, which are in order of their starts."""
    origin = F.struct(start.cast("bigint").alias("at"), F.array().cast(PARTS).alias("out"))
    end = start + F.length(word)

    def part(a: Column, b: Column) -> Column:
        cut = F.struct(a.alias("start"), F.substring(word, (a - start + 1).cast("int"), (b - a).cast("int")).alias("word"))
        return F.when(b - a >= WINDOW, F.array(cut)).otherwise(F.array()).cast(PARTS)

    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], part(acc["at"], F.least(s["start"], end))).alias("out")
    )
    crossing = F.filter(spans, lambda s: (s["start"] < end) & (start < s["end"]))
    return F.aggregate(crossing, origin, step, lambda acc: F.concat(acc["out"], part(acc["at"], end)))


def secret_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``base`` and ``added``: arrays of spans ``(start, rank, end, kind)``, by start, then kind.

    NULL texts are empty. Nothing is shuffled. Texts without a trace of a pattern are told by plain
    substring searches and skip the patterns.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    traced = docs.select(
        *keep, t.alias("_t"), F.lower(t).alias("_low"),
    ).select(
        *keep, "_t",
        (F.col("_low").contains("passw") | F.col("_low").contains("secret") | F.col("_low").contains("token") | F.col("_low").contains("api")).alias("_a"),
        F.col("_t").contains("AKIA").alias("_k"),
        F.col("_t").rlike("[0-9]").alias("_d"),
    )
    text = F.col("_t")
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        pattern = HEX_RUNS if kind == "hex" else pattern
        here = _spans(text, pattern, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), least, kind, rank)
        # A run of 24 letters a to f has no digit, so the hex pattern is tried on every text.
        trace = {"assign": F.col("_a"), "access": F.col("_k"), "hex": text.rlike(HEX_RUNS)}[kind]
        found.append(F.when(trace, here).otherwise(_none()).alias(f"_{kind}"))
    entropy = len(KINDS)
    runs = F.arrays_zip(
        F.transform(F.split(text, CANDIDATE, -1), lambda s: F.length(s).cast("bigint")).alias("gap"),
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("word"),
    )

    def locate(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        entry = F.array(F.struct(begin.alias("start"), m["word"].alias("word"))).cast(PARTS)
        wanted = F.coalesce(m["word"].rlike("[0-9]") & m["word"].rlike("[A-Za-z]"), F.lit(False))
        return F.struct(
            (begin + F.coalesce(F.length(m["word"]), F.lit(0))).alias("at"),
            F.when(wanted, F.concat(acc["out"], entry)).otherwise(acc["out"]).alias("out"),
        )

    origin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(PARTS).alias("out"))
    candidates = F.when(F.col("_d"), F.aggregate(runs, origin, locate, lambda a: a["out"])).otherwise(F.array().cast(PARTS))
    located = traced.select(*keep, *found, candidates.alias("_c"))
    merged = located.select(*keep, "_c", F.sort_array(F.concat("_assign", "_access", "_hex")).alias("base"))

    def parts(c: Column) -> Column:
        word = c["word"]
        allowed = _spans(word, ENTRY, F.regexp_extract_all(word, F.lit(ENTRY), F.lit(0)), 1, "allowed", entropy)

        def widened(s: Column) -> Column:
            begin = F.greatest(s["start"] - BESIDE, F.lit(0))
            left = F.regexp_extract(F.substring(word, (begin + 1).cast("int"), (s["start"] - begin).cast("int")), "[A-Za-z0-9]*$", 0)
            right = F.regexp_extract(F.substring(word, (s["end"] + 1).cast("int"), F.lit(BESIDE)), "^[A-Za-z0-9]*", 0)
            return F.struct(
                (s["start"] + c["start"] - F.length(left)).alias("start"), s["rank"].alias("rank"), (s["end"] + c["start"] + F.length(right)).alias("end"), s["kind"].alias("kind")
            )

        moved = F.transform(allowed, widened).cast(SPAN)
        cuts = F.sort_array(F.concat("base", F.when(word.rlike(ALLOWED), moved).otherwise(_none())))
        kept = F.filter(_outside(c["start"], word, cuts), lambda p: p["word"].rlike("[0-9]") & p["word"].rlike("[A-Za-z]"))
        return kept

    cut = merged.withColumn("_p", F.flatten(F.transform("_c", parts)))
    measured = cut.withColumn("_e", F.transform("_p", lambda c: F.struct(c["start"].alias("start"), _entropy_span(c["word"]).alias("at"))))
    added = F.transform(
        F.filter("_e", lambda e: e["at"]["first"].isNotNull()),
        lambda e: F.struct(
            (e["start"] + e["at"]["first"]).alias("start"), F.lit(entropy).alias("rank"),
            (e["start"] + e["at"]["last"]).alias("end"), F.lit("entropy").alias("kind"),
        ),
    ).cast(SPAN)
    return measured.select(*keep, "base", added.alias("added"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, spans of each kind counted, digest of the base ones, all spans as text.

    NULL and empty texts have no spans. Texts and candidates of any length are scanned whole. Repeated rows
    have a row each, a NULL id is kept; other columns are not looked at. An empty table gives an empty result.
    """
    found = secret_spans(docs, ["doc_id"])
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )
