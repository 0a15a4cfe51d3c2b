"""Secret scans with multipart credential linking (operator 4). DataFrame functions only.

Base spans come from three patterns. Access identifiers open a scope of characters around them; secrets and endpoints
near one are joined to it as intervals: scopes are dealt into bins of the scope's width, parts into the bin they begin in. Weak
candidates are reported only as parts of a credential: a bare 40-character secret in a scope with an access identifier, an
endpoint in a scope that also has such a secret. Places are code points, from 0, ends exclusive.

Defined cases: null text counts as empty and has no spans; rows repeated with doc_id and text get the same result each; a null doc_id is carried
through; ties between spans go by kind as listed, then by end; other columns are passed by (redact() keeps them); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import cut, fresh, text_key

KINDS = ("assign", "access", "hex", "secret", "endpoint")
#: The base patterns, each with the least characters of what counts in a match. Matches of assign that fail are still used up.
#: No pattern repeats a group: the engine would recurse once a round, and a long text would overflow the stack.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Weak parts: a bare 40-character secret with small and capital letters and digits (a '=' before it assigns it, one behind it pads something longer), and an endpoint.
SECRET = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?:https?://[A-Za-z0-9.-]+(?::[0-9]+)?|(?<![A-Za-z0-9.-])[a-z0-9-][a-z0-9.-]*\.amazonaws\.com)"
#: Characters that a scope reaches to both sides of an access identifier.
SCOPE = 400

#: Matches whose places are summed up in one fold (an appended array is copied each time), and characters of the blocks that redaction works on.
FOLD = 256
BLOCK, BLOCKS = 8192, 16

SPANS = "array<struct<start:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once a row, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def _found(text: Column, pattern: str, group: int | None = None, least: int = 0, also: str | None = None) -> Column:
    """Spans of all matches whose `group` has `least` characters. What lies between matches comes from split(), so places are running sums of lengths.

    Sums run within blocks of FOLD matches and then over the blocks, so no array grows by more than a block and the work is all but linear.
    """
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match
    gap = F.transform(F.split(text, pattern, -1), F.length)
    good = F.transform(value, lambda v: F.length(v) >= least)
    if also:
        good = F.zip_with(good, match, lambda a, m: a & m.rlike(also))
    found = F.struct(gap.alias("gap"), F.transform(match, F.length).alias("size"), good.alias("good"))

    def places(x: Column) -> Column:
        n = F.size(x["size"])
        blocks = F.sequence(F.lit(0), F.floor((n - 1) / FOLD).cast("int"))
        within = lambda b: F.sequence(b * FOLD, F.least(n, (b + 1) * FOLD) - 1)
        lengths = F.transform(blocks, lambda b: F.aggregate(within(b), F.lit(0), lambda s, i: s + F.get(x["gap"], i) + F.get(x["size"], i)))
        begins = F.aggregate(lengths, F.array(F.lit(0)), lambda at, n: F.array_append(at, F.element_at(at, -1) + n))

        def step(at: Column, i: Column) -> Column:
            start = at["pos"] + F.get(x["gap"], i)
            end = start + F.get(x["size"], i)
            span = F.struct(start.alias("start"), end.alias("end"))
            return F.struct(end.alias("pos"), F.when(F.get(x["good"], i), F.array_append(at["out"], span)).otherwise(at["out"]).alias("out"))

        def spans(begin: Column) -> Column:
            zero = lambda b: F.struct(F.get(begin, b).alias("pos"), F.array().cast(SPANS).alias("out"))
            return F.flatten(F.transform(blocks, lambda b: F.aggregate(within(b), zero(b), step, lambda at: at["out"])))

        return _let(begins, spans)

    return F.when(text.rlike(pattern), _let(found, places)).otherwise(F.array().cast(SPANS))


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, key and an array of spans for each of KINDS. Weak parts are sought only in texts that have an access identifier."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text_key().alias("key"), text.alias("text"))
    weak = F.col("text").rlike(ACCESS)
    none = F.array().cast(SPANS)
    return rows.select(
        "doc_id", "key",
        _found(F.col("text"), ASSIGN, 2, ASSIGN_LEAST).alias("assign"),
        _found(F.col("text"), ACCESS).alias("access"),
        _found(F.col("text"), HEX).alias("hex"),
        F.when(weak, _found(F.col("text"), SECRET, also="(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])")).otherwise(none).alias("secret"),
        F.when(weak, _found(F.col("text"), ENDPOINT)).otherwise(none).alias("endpoint"),
    )


def _kind(column: str) -> Column:
    """Spans of a kind as (start, kind, end), which sort as reports want them."""
    k = KINDS.index(column)
    return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))


def linked(found: DataFrame) -> DataFrame:
    """doc_id, key, linked (array of (start, kind, end)): the weak parts that complete a credential."""
    some = found.filter("size(access) > 0 and size(secret) > 0").dropDuplicates(["doc_id", "key"])
    scope = (
        some.select("doc_id", "key", F.explode("access").alias("a"))
        .select(
            F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("a.start").alias("at"), (F.col("a.start") - SCOPE).alias("lo"),
            (F.col("a.end") + SCOPE).alias("hi"),
        )
    )
    scope = scope.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lo") / SCOPE), F.floor(F.col("hi") / SCOPE))))
    part = (
        some.select("doc_id", "key", F.explode(F.concat(_kind("secret"), _kind("endpoint"))).alias("span"))
        .withColumn("bin", F.floor(F.col("span.start") / SCOPE))
    )
    near = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")) & (F.col("bin") == F.col("_bin"))
    inside = (F.col("span.start") >= F.col("lo")) & (F.col("span.end") <= F.col("hi"))
    scopes = part.join(scope, near & inside).groupBy("doc_id", "key", "at").agg(F.collect_set("span").alias("spans"))  # a scope's width bounds it
    whole = scopes.filter(F.exists("spans", lambda s: s["kind"] == KINDS.index("secret")))
    return whole.select("doc_id", "key", F.explode("spans").alias("span")).groupBy("doc_id", "key").agg(F.collect_set("span").alias("linked"))


def _names(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, key, base and spans (arrays of (start, kind, end), the place of kind in KINDS) for each row of `docs`; spans hold base ones and linked ones."""
    found = cut(parts(docs))
    link = linked(found).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "linked")
    base = F.sort_array(F.concat(_kind("assign"), _kind("access"), _kind("hex")))
    rows = found.select("doc_id", "key", base.alias("base"))
    joined = rows.join(link, rows["doc_id"].eqNullSafe(link["_d"]) & (rows["key"] == link["_k"]), "left")
    both = F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "linked")))
    return joined.select("doc_id", "key", "base", both.alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined) for each row."""
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return (
        find_secrets(docs)
        .select(
            "doc_id", of("assign"), of("access"), of("hex"), F.sha2(_names(F.col("base")), 256).alias("base_sha256"),
            _names(F.col("spans")).alias("spans"),
        )
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of `docs`, all columns kept, with every secret span of `text` replaced by `mark`; n_chars, if there, follows."""
    key, spans, clear, d, k = (fresh(docs, x) for x in ("_key", "_spans", "_clean", "_d", "_k"))
    hits = (
        find_secrets(docs).filter("size(spans) > 0").dropDuplicates(["doc_id", "key"])
        .select(F.col("doc_id").alias(d), F.col("key").alias(k), F.col("spans").alias(spans))
    )
    rows = docs.withColumn(key, text_key())
    joined = rows.join(hits, rows["doc_id"].eqNullSafe(hits[d]) & (rows[key] == hits[k]), "left")

    whole, wide = F.col("text"), BLOCK * BLOCKS
    span_of = lambda held, lo, n: F.filter(held, lambda s: (s["start"] < lo + n) & (s["end"] > lo))

    def clean_block(text: Column, base: Column, held: Column, lo: Column) -> Column:
        """The BLOCK characters from `lo` on, of a text that begins at `base`."""
        block = F.substring(text, lo - base + 1, F.lit(BLOCK))

        def step(at: Column, s: Column) -> Column:
            starts = s["start"] >= at["pos"]
            before = F.substring(at["block"], at["pos"] - lo + 1, s["start"] - at["pos"])
            more = F.when(starts, F.concat(at["out"], before, F.lit(mark))).otherwise(at["out"])
            return F.struct(at["block"].alias("block"), F.greatest(at["pos"], F.least(s["end"], lo + BLOCK)).alias("pos"), more.alias("out"))

        zero = F.struct(block.alias("block"), lo.alias("pos"), F.lit("").alias("out"))
        return (
            F.aggregate(
                span_of(held, lo, BLOCK), zero, step,
                lambda at: F.concat(at["out"], F.substring(at["block"], at["pos"] - lo + 1, F.lit(BLOCK))),
            )
        )

    def clean_stretch(k: Column) -> Column:
        """A stretch of BLOCKS blocks. substring() walks a text from its begin and filter() all spans, so blocks are cut out of stretches, not of the whole."""
        base = k * wide
        held = F.struct(F.substring(whole, base + 1, F.lit(wide)).alias("text"), span_of(F.col(spans), base, wide).alias("spans"))
        return (
            _let(
                held,
                lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: clean_block(x["text"], base, x["spans"], base + b * BLOCK)), ""),
            )
        )

    clean = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / wide).cast("int")), clean_stretch), "")
    out = joined.withColumn(clear, F.when(F.col(spans).isNull(), F.col("text")).otherwise(clean))
    new = {"text": F.col(clear)} | ({"n_chars": F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length(clear).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))
