"""Registered queries of reads, regions, evidence and records, beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixloom.config import HIFI
from helixloom.functions import sequences as seq
from helixloom.functions import stats
from helixloom.operators import intervals, reads, somatic
from helixloom.plans import bindings as b
from helixloom.plans import functions as kernels
from helixloom.plans.registry import query
from helixloom.sinks import alignments
from helixloom.sources import fasta, regions, sam

# Regions and reads ----------------------------------------------------------------------------------------------------

IV = f"WITH iv AS ({b.IV_SQL}), r AS (SELECT * FROM iv WHERE id % 2 = 0), q AS (SELECT * FROM iv WHERE id % 2 = 1)"
WIDTH = 6 * b.HOUR


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    iv = b.intervals(spark, d)
    return iv.filter("id % 2 = 0").withColumnRenamed("id", "region_id"), iv.filter("id % 2 = 1").withColumnRenamed("id", "read_id")


@query(f"""{IV} SELECT r.grp, r.id AS region_id, q.id AS read_id, CASE WHEN q.st <= r.st THEN 1 ELSE 0 END + CASE WHEN q.en >= r.en THEN 2 ELSE 0 END AS cover
 FROM r JOIN q ON r.grp = q.grp AND r.st < q.en AND q.st < r.en""")
def region_reads(spark, d):
    """Reads of a region, and which of its ends they cover."""
    r, q = _halves(spark, d)
    return reads.region_reads(r, q, ["grp"], WIDTH)


@query(f"{IV} SELECT q.grp, q.id AS a_id, r.id AS b_id FROM q JOIN r ON q.grp = r.grp AND q.st <= r.st AND q.en >= r.en")
def interval_containing_join(spark, d):
    r, q = _halves(spark, d)
    out = intervals.containing_join(q.withColumnRenamed("read_id", "id"), r.withColumnRenamed("region_id", "id"), ["grp"], WIDTH)
    return out.select("grp", "a_id", "b_id")


@query(f"{IV} SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY label, en - st, st) AS region_rank FROM iv")
def region_order(spark, d):
    """Least noisy regions first, then the shortest."""
    iv = b.intervals(spark, d)
    return reads.region_order(iv, ["grp"]).select("grp", "id", F.col("region_rank").cast("long").alias("region_rank"))


@query(f"""{IV}, u AS (SELECT grp, st - 60000000 AS st, en + 60000000 AS en FROM r UNION ALL SELECT grp, st, en FROM q),
 i AS (SELECT *, max(en) OVER (PARTITION BY grp ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u),
 n AS (SELECT *, sum(CASE WHEN before IS NULL OR st > before THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS island FROM i)
 SELECT grp, min(st) AS st, max(en) AS en, count(*) AS n FROM n GROUP BY grp, island""")
def interval_union_merge(spark, d):
    """Two sets of intervals, one of them flanked, as one."""
    r, q = _halves(spark, d)
    wide = r.select("grp", (F.col("st") - 60_000_000).alias("st"), (F.col("en") + 60_000_000).alias("en"))
    return intervals.merge_fixed(wide.unionByName(q.select("grp", "st", "en")), ["grp"], 0, 24 * b.HOUR)


#: Minutes: regions grow past chains of points less than ten apart that lie within ten of an end, then get ten on both sides, and touching ones merge.
@query(f"""{IV}, v AS (SELECT grp, st // 60000000 AS st, st // 60000000 + 1 AS en FROM q), g AS (SELECT DISTINCT grp, st // 60000000 AS st, greatest(en // 60000000, st // 60000000 + 1) AS en FROM r),
 i AS (SELECT *, max(en) OVER (PARTITION BY grp ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
 n AS (SELECT *, sum(CASE WHEN before IS NULL OR st > before + 9 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS island FROM i),
 c AS (SELECT grp, min(st) AS st, max(en) AS en FROM n GROUP BY grp, island),
 w AS (SELECT g.grp, greatest(0, least(g.st, coalesce(min(c.st), g.st)) - 10) AS st, greatest(g.en, coalesce(max(c.en), g.en)) + 10 AS en
  FROM g LEFT JOIN c ON g.grp = c.grp AND g.st - 10 < c.en AND c.st < g.en + 10 GROUP BY g.grp, g.st, g.en),
 j AS (SELECT *, max(en) OVER (PARTITION BY grp ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w),
 m AS (SELECT *, sum(CASE WHEN before IS NULL OR st > before THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS island FROM j)
 SELECT grp, min(st) AS st, max(en) AS en FROM m GROUP BY grp, island""")
def region_flank(spark, d):
    r, q = _halves(spark, d)
    minute = lambda c: F.floor(F.col(c) / 60_000_000)
    g = r.select("grp", minute("st").alias("st"), F.greatest(minute("en"), minute("st") + 1).alias("en"))
    return intervals.flanked(g, q.select("grp", minute("st").alias("st"), (minute("st") + 1).alias("en")), ["grp"])


REGION_READS = "SELECT l_partkey // 40 AS region, l_orderkey AS read_id, l_suppkey % 3 * 10 + 10 AS phase_set, l_linenumber % 3 AS hap, l_quantity > 20 AS is_full FROM lineitem"


@query(f"""WITH t AS ({REGION_READS}), g AS (SELECT region, phase_set, count(*) FILTER (hap = 1 AND is_full) AS f1, count(*) FILTER (hap = 2 AND is_full) AS f2, count(*) FILTER (hap = 1) AS a1, count(*) FILTER (hap = 2) AS a2 FROM t WHERE hap > 0 GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY least(f1, f2) DESC, greatest(f1, f2) DESC, phase_set) AS k FROM g WHERE least(f1, f2) >= 1 AND least(a1, a2) >= 2) SELECT region, phase_set FROM k WHERE k = 1""")
def region_phase_set(spark, d):
    t = b.view(spark, d, REGION_READS.replace("//", "DIV"), "lineitem")
    return reads.phase_set_of_region(t.withColumnRenamed("is_full", "full"), ["region"], HIFI)


@query("""WITH c AS (SELECT n_name AS contig, (n_nationkey + 1) * 123456 AS length FROM nation),
 t AS (SELECT contig, length, n_regionkey, CASE n_regionkey WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 70000 WHEN 3 THEN 100001 ELSE 5 END AS beg, CASE n_regionkey WHEN 0 THEN length WHEN 1 THEN length ELSE least(length, 200000) END AS fin FROM c JOIN nation ON n_name = contig)
 SELECT contig, CAST(x AS BIGINT) AS beg, least(x + 499999, fin) AS fin FROM (SELECT contig, fin, unnest(generate_series(beg, fin, 500000)) AS x FROM t WHERE beg <= fin)""")
def region_texts(spark, d):
    """Region texts of all forms, one a nation, against contigs."""
    n = b.table(spark, d, "nation")
    contigs = n.select(F.col("n_name").alias("contig"), ((F.col("n_nationkey") + 1) * 123456).cast("long").alias("length"))
    form = {0: "", 1: ":1,000", 2: ":70000-200,000", 3: ":100001-200000", 4: ":5-200000"}
    texts = [r["n_name"] + form[r["n_regionkey"]] for r in n.select("n_name", "n_regionkey").collect()]  # a call's own options
    return regions.from_texts(spark, [*texts, "unknown:1-5"], contigs).select("contig", "beg", F.col("end").alias("fin"))


@query("SELECT read_id, unnest(generate_series((pos - 1) // 500, (fin - 1) // 500)) AS chunk FROM (SELECT o_orderkey AS read_id, o_custkey * 7 + 1 AS pos, o_custkey * 7 + 1 + CAST(floor(o_totalprice / 100) AS BIGINT) AS fin FROM orders)")
def read_chunks(spark, d):
    """The windows that each read touches."""
    o = (
        b.table(spark, d, "orders")
        .select(
            F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") * 7 + 1).alias("pos"),
            (F.col("o_custkey") * 7 + 1 + F.floor(F.col("o_totalprice") / 100)).alias("end"),
        )
    )
    return sam.with_chunks(o, 500).select("read_id", "chunk")


# Reference and sequences ------------------------------------------------------------------------------------------------

SEQ = f"WITH s AS ({b.SEQ_SQL})"


@query(f"""{SEQ}, w AS (SELECT 'c' || id AS contig, seq, unnest(range(1, length(seq) + 1, 7)) AS beg FROM s)
 SELECT contig, CAST(beg AS BIGINT) AS beg, greatest(beg - 30, 1) AS ref_beg, substr(seq, CAST(greatest(beg - 30, 1) AS INT), CAST(beg + 50 + 30 - greatest(beg - 30, 1) + 1 AS INT)) AS ref_seq FROM w""")
def reference_slices(spark, d):
    """Slices of flanked regions out of bins of 64 bases."""
    s = b.sequences(spark, d).select(F.concat(F.lit("c"), "id").alias("contig"), "seq")
    at = s.select("contig", F.explode(F.sequence(F.lit(1).cast("long"), F.length("seq").cast("long"), F.lit(7).cast("long"))).alias("beg"))
    return fasta.slices(fasta.binned(s, 64), at.withColumn("end", F.col("beg") + 50), 30, 64).select("contig", "beg", "ref_beg", "ref_seq")


@query(f"{SEQ}, w AS (SELECT 'c' || id AS contig, seq, unnest(range(1, length(seq) + 1)) AS pos FROM s) SELECT contig, CAST(pos AS BIGINT) AS pos, substr(seq, CAST(pos AS INT), CAST(1 + pos % 90 AS INT)) AS bases FROM w")
def reference_bases(spark, d):
    s = b.sequences(spark, d).select(F.concat(F.lit("c"), "id").alias("contig"), "seq")
    at = s.select("contig", F.explode(F.sequence(F.lit(1).cast("long"), F.length("seq").cast("long"))).alias("pos"))
    return fasta.base_at(fasta.binned(s), at, 1 + F.col("pos") % 90)


@query(f"{SEQ}, p AS (SELECT id, seq, unnest(range(1, length(seq) - 7)) AS i FROM s) SELECT id, CAST(i AS BIGINT) AS i, substr(seq, CAST(i AS INT), 9) = repeat(substr(seq, CAST(i AS INT), 3), 3) AS triple FROM p")
def triple_repeats(spark, d):
    """Places where the next bases are three copies of the three there."""
    rows = b.sequences(spark, d).select("id", F.posexplode(seq.windows(F.col("seq"), 9)).alias("k", "w"))
    return rows.select("id", (F.col("k") + 1).cast("long").alias("i"), seq.triple_repeat(F.substring("w", 1, 3), F.col("w")).alias("triple"))


@query(f"""{SEQ}, p AS (SELECT substr(seq, CAST(i AS INT), 7) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 5)) AS i FROM s)) SELECT DISTINCT kmer, CAST({' + '.join(f"(instr('ACGT', substr(kmer, {k}, 1)) - 1) * {4 ** (7 - k)}" for k in range(1, 8))} AS BIGINT) AS code FROM p WHERE NOT contains(kmer, 'N')""")
def kmer_codes(spark, d):
    k = b.sequences(spark, d).select(F.explode(seq.kmers(F.col("seq"), 7)).alias("kmer")).distinct()
    return k.select("kmer", seq.kmer_code(F.col("kmer"), 7).alias("code"))


#: All stretches of up to 18 triplets, their equal pairs of triplets, and whether a part of one scores more; the union of those that are perfect.
@query(f"""{SEQ}, w AS (SELECT id, CAST(i AS INT) AS i, substr(seq, CAST(i AS INT) + 1, 3) AS t FROM (SELECT id, seq, unnest(range(0, length(seq) - 2)) AS i FROM s)),
 ok AS (SELECT id, i, t FROM w WHERE NOT contains(t, 'N')), runs AS (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS run FROM ok),
 pairs AS (SELECT x.id, x.i AS a, y.i AS b FROM runs x JOIN runs y ON x.id = y.id AND x.run = y.run AND y.i BETWEEN x.i + 1 AND x.i + 17 AND x.t = y.t),
 spans AS (SELECT x.id, x.i AS a, y.i AS b, y.i - x.i AS n FROM runs x JOIN runs y ON x.id = y.id AND x.run = y.run AND y.i BETWEEN x.i + 1 AND x.i + 17),
 scored AS (SELECT spans.id, spans.a, spans.b, n, count(pairs.a) AS c FROM spans LEFT JOIN pairs ON pairs.id = spans.id AND pairs.a >= spans.a AND pairs.b <= spans.b GROUP BY ALL),
 high AS (SELECT * FROM scored WHERE 10 * c > 5 * n),
 perfect AS (SELECT id, a, b + 3 AS e FROM high x WHERE NOT EXISTS (SELECT 1 FROM high y WHERE x.id = y.id AND y.a >= x.a AND y.b <= x.b AND y.c * x.n > x.c * y.n)),
 i1 AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM perfect),
 i2 AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY a, e ROWS UNBOUNDED PRECEDING) AS island FROM i1)
 SELECT id, min(a) AS st, max(e) AS en FROM i2 GROUP BY id, island""")
def dust_mask(spark, d):
    """Low-complexity stretches of all passages."""
    return b.sequences(spark, d).select("id", F.inline(kernels.dust_mask("seq")))


@query(f"{SEQ} SELECT x.id, CAST(levenshtein(x.seq, y.seq) AS INT) AS distance FROM s x JOIN s y ON y.id = x.id + 1")
def sql_functions(spark, d):
    """A kernel called from SQL text."""
    kernels.register(spark)
    return spark.sql("SELECT x.id, edit_distance(x.seq, y.seq) AS distance FROM {s} x JOIN {s} y ON y.id = x.id + 1", s=b.sequences(spark, d))


# Reads, events, records ---------------------------------------------------------------------------------------------------

LINES = "SELECT l_orderkey AS read_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS line, l_partkey AS pos, l_linenumber AS clip, CAST(l_quantity AS INT) AS n, l_suppkey % 9 + 1 AS ins, l_partkey % 8 + 1 AS mid, l_suppkey % 5 + 1 AS del FROM lineitem"


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """Reads of the form clip, matches, a mismatch, an insertion, matches, a deletion, four matches."""
    t = b.view(spark, d, LINES, "lineitem")
    cigar = F.concat("clip", F.lit("S"), "n", F.lit("=1X"), "ins", F.lit("I"), "mid", F.lit("="), "del", F.lit("D4="))
    size = (F.col("clip") + F.col("n") + 1 + F.col("ins") + F.col("mid") + 4).cast("int")
    qname = F.concat(F.col("read_id"), F.lit("/"), F.col("line"))
    return t.select(
        "*", qname.alias("qname"), F.lit(0).alias("flag"), F.lit("c").alias("contig"), F.lit(60).alias("mapq"), cigar.alias("cigar"), F.repeat(F.lit("A"), size).alias("seq"),
        F.lit(None).cast("binary").alias("qual"), F.create_map().cast("map<string,string>").alias("tags"), (F.col("pos") + F.col("n") + F.col("mid") + F.col("del") + 4).alias("end"),
    )


OPS = "unnest(['S', '=', 'X', 'I', '=', 'D', '=']) AS op, unnest([clip, n, 1, ins, mid, del, 4]) AS len, unnest([pos, pos, pos + n, pos + n + 1, pos + n + 1, pos + n + 1 + mid, pos + n + 1 + mid + del]) AS ref_pos, unnest([0, clip, clip + n, clip + n + 1, clip + n + 1 + ins, clip + n + 1 + ins + mid, clip + n + 1 + ins + mid]) AS qi"


@query(f"WITH t AS ({LINES}) SELECT read_id, line, unnest(range(0, 7)) AS k, {OPS} FROM t")
def read_events(spark, d):
    """The decoder's own events of all reads."""
    from helixloom.operators.decode import decode

    rows = decode(_aligned(spark, d), HIFI).select("read_id", "line", F.posexplode("events").alias("k", "e"))
    return (
        rows.select(
            "read_id", "line", F.col("k").cast("long").alias("k"), "e.op", F.col("e.len").cast("long").alias("len"),
            F.col("e.pos").alias("ref_pos"), F.col("e.qi").cast("long").alias("qi"),
        )
    )


#: The same reads with M operations, told by a cs tag, a MD tag or the reference alone.
@query(f"""WITH t AS ({LINES}), k AS (SELECT *, unnest(['cs', 'MD', 'reference']) AS told FROM t)
 SELECT read_id, line, told, 'S' || clip || ' ' || pos || ':0,=' || n || ' ' || pos || ':' || clip || ',X1 ' || (pos + n) || ':' || (clip + n) || ',I' || ins || ' ' || (pos + n + 1) || ':' || (clip + n + 1)
  || ',=' || mid || ' ' || (pos + n + 1) || ':' || (clip + n + 1 + ins) || ',D' || del || ' ' || (pos + n + 1 + mid) || ':' || (clip + n + 1 + ins + mid) || ',=4 ' || (pos + n + 1 + mid + del) || ':' || (clip + n + 1 + ins + mid) AS events FROM k""")
def read_decoders(spark, d):
    from helixloom.operators.decode import decode

    many = lambda letter, c: F.repeat(F.lit(letter), F.col(c).cast("int"))
    plain = F.concat("clip", F.lit("S"), F.col("n") + 1, F.lit("M"), "ins", F.lit("I"), "mid", F.lit("M"), "del", F.lit("D4M"))
    cs = F.concat(F.lit(":"), "n", F.lit("*ca+"), many("a", "ins"), F.lit(":"), "mid", F.lit("-"), many("g", "del"), F.lit(":4"))
    md = F.concat("n", F.lit("C"), "mid", F.lit("^"), many("G", "del"), F.lit("4"))
    ref = F.concat(many("A", "n"), F.lit("C"), many("A", "mid"), many("G", "del"), F.lit("AAAA"))
    rows = _aligned(spark, d).withColumn("cigar", plain).withColumn("told", F.explode(F.array(F.lit("cs"), F.lit("MD"), F.lit("reference"))))
    tags = F.when(F.col("told") == "cs", F.create_map(F.lit("cs"), cs)).when(F.col("told") == "MD", F.create_map(F.lit("MD"), md)).otherwise(F.col("tags"))
    rows = rows.withColumn("tags", tags).withColumn("ref_seq", F.when(F.col("told") == "reference", ref)).withColumn("ref_beg", F.col("pos"))
    text = F.array_join(F.transform("events", lambda e: F.concat(e["op"], e["len"], F.lit(" "), e["pos"], F.lit(":"), e["qi"])), ",")
    rows = rows.drop("qname", "mapq", "clip", "n", "ins", "mid", "del")  # what goes through Python comes back
    return decode(rows, HIFI).select("read_id", "line", "told", text.alias("events"))


@query(f"WITH t AS ({LINES}) SELECT read_id, line, qname, sam FROM (SELECT read_id, line, read_id || '/' || line AS qname, clip || 'S' || n || '=1X' || ins || 'I' || mid || '=' || del || 'D4=' AS cigar, pos, repeat('A', CAST(clip + n + 1 + ins + mid + 4 AS INT)) AS seq, concat_ws(chr(9), qname, '0', 'c', pos, '60', cigar, '*', '0', '0', seq, '*') AS sam FROM t)")
def sam_lines(spark, d):
    lines = (
        alignments.sam_line(_aligned(spark, d).withColumn("qual", F.lit(b"")))
        .select(F.col("value").alias("sam"), F.split("value", "\t")[0].alias("qname"))
    )
    return (
        lines.select(
            F.split("qname", "/")[0].cast("long").alias("read_id"), F.split("qname", "/")[1].cast("long").alias("line"), "qname", "sam",
        )
    )


@query(f"""WITH t AS ({LINES}) SELECT read_id, line, CAST(1 + ins + del AS INT) AS nm, n || 'C' || mid || '^' || repeat('G', CAST(del AS INT)) || '4' AS md,
 ':' || n || '*ca' || '+' || repeat('t', CAST(ins AS INT)) || ':' || mid || '-' || repeat('g', CAST(del AS INT)) || ':4' AS cs, clip || 'S' || n || '=1X' || ins || 'I' || mid || '=' || del || 'D4=' AS cigar FROM t""")
def record_tags(spark, d):
    """NM, MD, cs and CIGAR of events."""
    event = lambda op, n, alt="", ref="": F.struct(F.lit(op).alias("op"), F.col(n).cast("int").alias("len") if isinstance(n, str) else F.lit(n).alias("len"), F.repeat(F.lit(alt), F.col(n).cast("int")).alias("alt") if alt and isinstance(n, str) else F.lit(alt).alias("alt"), F.repeat(F.lit(ref), F.col(n).cast("int")).alias("ref") if ref and isinstance(n, str) else F.lit(ref).alias("ref"))
    e = (
        F.array(
            event("S", "clip"), event("=", "n"), event("X", 1, "A", "C"), event("I", "ins", "T"), event("=", "mid"),
            event("D", "del", ref="G"), event("=", 4),
        )
    )
    rows = _aligned(spark, d).withColumn("e", e)
    return (
        rows.select(
            "read_id", "line", alignments.edit_distance(F.col("e")).alias("nm"), alignments.md_of(F.col("e")).alias("md"),
            alignments.cs_of(F.col("e")).alias("cs"), alignments.cigar_of(F.col("e")).alias("cigar"),
        )
    )


@query("""WITH r AS (SELECT o_orderkey AS qname, o_custkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 16 END AS flag FROM orders), h AS (SELECT l_orderkey AS qname, min(l_linenumber % 3) AS hap, max(l_partkey) AS phase_set FROM lineitem GROUP BY 1)
 SELECT r.qname, CASE WHEN hap > 0 THEN CAST(hap AS VARCHAR) END AS hp, CASE WHEN hap > 0 AND phase_set > 0 THEN CAST(phase_set AS VARCHAR) END AS ps, 'kept' AS xx FROM r LEFT JOIN h ON r.qname = h.qname AND r.flag = 0""")
def haplotags(spark, d):
    """HP and PS tags; old ones go, and a record with another flag at the same place gets none."""
    o = b.table(spark, d, "orders")
    old = F.create_map(F.lit("HP"), F.lit("9"), F.lit("PS"), F.lit("8"), F.lit("XX"), F.lit("kept"))
    r = (
        o.select(
            F.col("o_orderkey").alias("qname"), F.lit("c").alias("contig"), F.col("o_custkey").alias("pos"),
            F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(16).alias("flag"), old.alias("tags"),
        )
    )
    line = (
        b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("qname"))
        .agg(F.min(F.col("l_linenumber") % 3).alias("hap"), F.max("l_partkey").alias("phase_set"))
    )
    h = r.select("qname", "contig", "pos").join(line, "qname").withColumn("flag", F.lit(0))
    out = alignments.haplotagged(r, h)
    return out.select("qname", F.col("tags")["HP"].alias("hp"), F.col("tags")["PS"].alias("ps"), F.col("tags")["XX"].alias("xx"))


#: Reads of one stretch of matches between a clip of ten bases or more and a contig's end: a clip beyond thirty makes the next hundred bases noisy and counts as an event; a read of too many of either is skipped.
@query(f"""WITH t AS ({LINES}), c AS (SELECT *, clip * 10 > 30 AS long, clip * 10 > 30 AND pos > 10 AS noisy FROM t)
 SELECT read_id, line, CASE WHEN noisy THEN pos - 1 ELSE -1 END AS st, CASE WHEN noisy THEN least(pos + n * 5 - 1, pos + 99) ELSE -1 END AS en, (NOT noisy OR least(n * 5, 100) + 1 <= 0.5 * n * 5) AND CASE WHEN long THEN 1 ELSE 0 END <= 0.05 * n * 5 AS kept FROM c""")
def read_noise(spark, d):
    """Noisy intervals of clipped reads, and which reads stay."""
    from helixloom.operators.decode import decode

    size = (F.col("clip") * 10 + F.col("n") * 5).cast("int")
    rows = _aligned(spark, d).withColumn("cigar", F.concat(F.col("clip") * 10, F.lit("S"), F.col("n") * 5, F.lit("="))).withColumn("seq", F.repeat(F.lit("A"), size))
    rows = decode(rows.withColumn("end", F.col("pos") + F.col("n") * 5 - 1), HIFI)
    first = F.get("noisy", F.lit(0))
    return rows.select("read_id", "line", F.coalesce(first["st"], F.lit(-1)).alias("st"), F.coalesce(first["en"], F.lit(-1)).alias("en"), "kept")


SINGLES = "SELECT 'c' || l_suppkey % 3 AS contig, l_partkey // 100 AS region_id, l_partkey AS pos, CASE l_linenumber % 2 WHEN 0 THEN 1 ELSE 8 END AS vtype, 0 AS ref_len, 1 AS alt_len, l_returnflag AS alt_seq, l_orderkey AS read_id FROM lineitem WHERE l_quantity > 30"


@query(f"WITH t AS ({SINGLES}) SELECT contig, region_id, pos, vtype, ref_len, alt_len, alt_seq, count(DISTINCT read_id) AS alt_cov FROM t GROUP BY ALL HAVING count(DISTINCT read_id) >= 2")
def region_candidates(spark, d):
    """Differences of noisy regions that enough single reads share."""
    from helixloom.operators.noisy import read_candidates

    called = b.view(spark, d, SINGLES.replace("//", "DIV"), "lineitem").withColumn("kind", F.lit("single"))
    return read_candidates(called.unionByName(called.withColumn("kind", F.lit("allele"))), ["contig"], HIFI)


@query("SELECT l_orderkey AS read_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, round(log10(greatest(pow(10, -l_quantity * 10), 1e-300)), 6) AS log_p FROM lineitem")
def clamped_logs(spark, d):
    line = b.table(spark, d, "lineitem")
    p = F.pow(F.lit(10.0), -F.col("l_quantity") * 10)
    return line.select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.round(stats.clamped_log10(p), 6).alias("log_p"))


@query(f"WITH t AS ({LINES}) SELECT read_id, line, clip >= 4 AND abs(place - pos) <= 30 AS near FROM (SELECT *, pos + n AS place FROM t)")
def long_clips(spark, d):
    """A clip of four bases at a read's end within thirty of a place."""
    from helixloom.operators.decode import cigar_ops

    rows = (
        _aligned(spark, d)
        .withColumn(
            "events",
            F.transform(cigar_ops(F.col("cigar"), F.col("pos")), lambda x: F.struct(x["op"].alias("op"), x["len"].alias("len"), x["ref_pos"].alias("pos"))),
        )
        .withColumn("at", F.col("pos") + F.col("n"))
    )
    return rows.select("read_id", "line", somatic.near_long_clip("events", "at", 4, 30).alias("near"))


# Evidence and filters ---------------------------------------------------------------------------------------------------

@query(f"""WITH p AS ({b.PROFILE}), h AS (SELECT *, read_id % 2 + 1 AS hap, var_id % 2 AS h1, 1 - var_id % 2 AS h2 FROM p)
 SELECT grp, read_id FROM h WHERE allele <> CASE WHEN hap = 1 THEN h1 ELSE h2 END GROUP BY 1, 2 HAVING count(*) >= 2""")
def conflicting_reads(spark, d):
    p = b.profile(spark, d).withColumn("hap", F.col("read_id") % 2 + 1)
    clean = (
        p.select("grp", "var_id").distinct().withColumn("hap1", (F.col("var_id") % 2).cast("int"))
        .withColumn("hap2", (1 - F.col("var_id") % 2).cast("int"))
    )
    return somatic.conflicting_reads(p, clean, ["grp"])


GAPS = "SELECT l_suppkey % 10 AS grp, l_orderkey AS read_id, l_partkey // 50 AS pos, CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 8 END AS vtype, l_linenumber % 4 AS len FROM lineitem"


@query(f"""WITH e AS ({GAPS}), v AS (SELECT DISTINCT grp, pos, vtype, len FROM e WHERE pos % 5 = 0), s AS (SELECT DISTINCT grp, read_id, pos AS var_id, pos FROM e),
 o AS (SELECT * FROM e WHERE vtype IN (1, 2) AND NOT EXISTS (SELECT 1 FROM v WHERE v.grp = e.grp AND v.pos = e.pos AND v.vtype = e.vtype AND v.len = e.len))
 SELECT s.grp, s.read_id, s.var_id, least(10, coalesce(min(abs(s.pos - o.pos)), 10)) AS indel_distance FROM s LEFT JOIN o ON s.grp = o.grp AND s.read_id = o.read_id GROUP BY 1, 2, 3""")
def indel_distances(spark, d):
    e = b.view(spark, d, GAPS.replace("//", "DIV"), "lineitem")
    v = e.filter("pos % 5 = 0").select("grp", "pos", "vtype", "len").distinct()
    s = e.select("grp", "read_id", F.col("pos").alias("var_id"), "pos").distinct()
    return somatic.indel_distance(e, s, v, ["grp"])


VARIANTS = "SELECT p_brand AS grp, p_partkey AS var_id, p_partkey * 7 AS beg, p_partkey * 7 + p_size % 4 AS fin FROM part"


@query(f"""WITH v AS ({VARIANTS}), a AS (SELECT v.grp, v.var_id, l_orderkey AS read_id FROM v JOIN lineitem ON l_partkey = v.var_id),
 s AS (SELECT *, coalesce(lead(beg, 5) OVER (PARTITION BY grp ORDER BY beg, var_id) - fin < 1000, false) AS starts FROM v),
 m AS (SELECT *, max(CAST(starts AS INT)) OVER (PARTITION BY grp ORDER BY beg, var_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 1 AS dense FROM s),
 bad AS (SELECT DISTINCT a.grp, a.read_id FROM a JOIN m ON a.grp = m.grp AND a.var_id = m.var_id WHERE m.dense),
 n AS (SELECT a.grp, a.var_id, count(*) AS n, count(bad.read_id) AS b FROM a LEFT JOIN bad ON a.grp = bad.grp AND a.read_id = bad.read_id GROUP BY 1, 2)
 SELECT m.grp, m.var_id FROM m LEFT JOIN n ON m.grp = n.grp AND m.var_id = n.var_id WHERE NOT m.dense AND NOT coalesce(2 * n.b >= n.n, false)""")
def somatic_post_process(spark, d):
    """Variants in dense runs go, and those half of whose reads carry one."""
    v = b.view(spark, d, VARIANTS, "part").withColumnRenamed("fin", "end")
    line = b.table(spark, d, "lineitem").select(F.col("l_partkey").alias("var_id"), F.col("l_orderkey").alias("read_id"))
    return somatic.post_process(v, v.select("grp", "var_id").join(line, "var_id"), ["grp"], HIFI).select("grp", "var_id")


EVIDENCE = """SELECT l_partkey AS var_id, CAST(l_quantity AS INT) AS qual, CAST(l_quantity AS INT) - l_linenumber AS window_qual, CAST(least(10, l_suppkey % 17) AS INT) AS indel_distance, CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS dense,
 CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS near_clip, CASE WHEN l_orderkey % 29 = 0 THEN 1 ELSE 0 END AS low_complexity_error, CASE WHEN l_orderkey % 31 = 0 THEN 1 ELSE 0 END AS homopolymer_error, l_linestatus = 'F' AS rev FROM lineitem"""


@query(f"""WITH e AS ({EVIDENCE}), s AS (SELECT p_partkey AS var_id, {b.VTYPE} AS vtype, p_size, p_partkey % 23 AS var_distance, CASE WHEN p_partkey % 2 = 0 THEN 100 ELSE 0 END AS phase_set, p_partkey % 3 = 0 AS te, p_partkey % 5 = 0 AS low, p_partkey % 11 = 0 AS germ FROM part),
 g AS (SELECT var_id, count(*) AS n, {', '.join(f"quantile_disc({c}, 0.5) AS {c}" for c in ("qual", "window_qual", "indel_distance", "dense", "near_clip", "low_complexity_error", "homopolymer_error"))}, min(low_complexity_error) AS lc, min(homopolymer_error) AS hp FROM e GROUP BY 1)
 SELECT var_id, n AS n_alt, CASE WHEN vtype = 8 THEN n >= 2 AND var_distance >= 5 AND indel_distance >= 5 AND dense = 0 AND near_clip = 0 AND CASE WHEN phase_set > 0 THEN qual >= 20 AND window_qual >= 10 AND lc = 0 AND hp = 0 ELSE qual >= 30 AND window_qual >= 20 AND low_complexity_error = 0 AND homopolymer_error = 0 END
  ELSE (n >= 2 OR te) AND (n > 1 OR NOT low) AND NOT germ AND dense = 0 AND near_clip = 0 END AS passes FROM g JOIN s USING (var_id)""")
def somatic_filters(spark, d):
    """Evidence of alt reads, and the filters of phased and unphased SNVs and of long gaps over it."""
    e = b.view(spark, d, EVIDENCE, "lineitem")
    at = b.sites(spark, d).withColumnRenamed("pos", "var_id").select("var_id", "vtype")
    at = at.withColumns({"var_distance": (F.col("var_id") % 23).cast("int"), "phase_set": F.when(F.col("var_id") % 2 == 0, 100).otherwise(0), "q1": F.lit(10), "q2": F.lit(20), "q3": F.lit(30)})
    te = F.col("var_id") % 3 == 0
    at = at.withColumns({"tsd_len": F.when(te, 7).otherwise(0), "polya_len": F.when(te, 25).otherwise(0), "te_id": F.lit(None).cast("long"), "is_low_complexity": F.col("var_id") % 5 == 0, "like_germline": F.col("var_id") % 11 == 0})
    return somatic.evidence(e, []).join(at, "var_id").select("var_id", "n_alt", somatic.passes(HIFI).alias("passes"))


#: Qualities go round forty by steps of seven along a read. The mismatch is the site; half of the reads know the insertion behind it as a variant.
QUAL = "(({0}) * 7 + read_id) % 40"


@query(f"""WITH t AS ({LINES}), q AS (SELECT *, clip + n AS qi, clip + n + 1 + ins + mid + 4 AS size FROM t),
 w AS (SELECT read_id, line, min({QUAL.format("x")}) AS window_qual FROM (SELECT *, unnest(range(greatest(0, qi - 3), least(size, qi + 4))) AS x FROM q) GROUP BY 1, 2)
 SELECT q.read_id, q.line, CASE WHEN {QUAL.format("qi").replace("read_id", "q.read_id")} < 10 THEN 0 ELSE {QUAL.format("qi").replace("read_id", "q.read_id")} END AS qual, w.window_qual,
 CASE WHEN q.read_id % 2 = 0 THEN least(10, 1 + mid) ELSE 1 END AS indel_distance, 0 AS dense, 0 AS near_clip FROM q JOIN w ON q.read_id = w.read_id AND q.line = w.line""")
def read_evidence(spark, d):
    """Evidence of single reads for a SNV: event and window qualities, the nearest gap that is no variant, dense differences, clips."""
    from helixloom.operators import evidence
    from helixloom.operators.decode import decode

    # (7 i + read_id) % 40 goes round with i; 7 * 23 is 1, so a read begins 23 read_id places on
    turn = bytes(7 * i % 40 for i in range(40)).hex()
    begin, size = F.pmod(F.col("read_id") * 23, F.lit(40)).cast("int"), F.length("seq")
    qual = F.unhex(F.substring(F.repeat(F.lit(turn), (size / 40).cast("int") + 2), begin * 2 + 1, size * 2))
    rows = _aligned(spark, d).withColumn("qual", qual).drop("qname", "mapq", "clip", "del")
    rows = decode(rows, HIFI).withColumn("e", F.element_at(F.filter("events", lambda e: e["op"] == "X"), 1))
    known = F.struct(
        (F.col("pos") + F.col("n") + 1).alias("pos"), F.lit("I").alias("op"), F.col("ins").cast("int").alias("len"), F.lit("").alias("alt"),
        F.lit(0).cast("long").alias("phase_set"), F.lit(0).alias("hap1"), F.lit(0).alias("hap2"),
    )
    none = F.lit(None)
    told = evidence.of_reads(rows.select(
        "read_id", F.col("line").cast("long").alias("var_id"), F.lit(False).alias("rev"), F.col("e.pos").alias("pos"), F.col("e.op").alias("op"), F.col("e.len").alias("len"), F.col("e.qi").alias("qi"),
        F.col("e.low_qual").alias("low_qual"), "events", "seq", "qual", F.when(F.col("read_id") % 2 == 0, F.array(known)).alias("known"), none.cast("string").alias("hap_seq"),
        none.cast("long").alias("hap_lo"), F.lit("A").alias("alt"), F.lit("C").alias("ref"), F.lit(1).alias("hap"), F.lit(0).cast("long").alias("phase_set"),
    ))
    return told.select("read_id", F.col("var_id").alias("line"), "qual", "window_qual", "indel_distance", "dense", "near_clip")


COUNTED = "SELECT l_partkey AS pos, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS a, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F') AS b, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS c, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'F') AS e FROM lineitem GROUP BY 1"


@query(f"WITH t AS ({COUNTED}) SELECT pos, round(lgamma(a+b+1) + lgamma(c+e+1) + lgamma(a+c+1) + lgamma(b+e+1) - lgamma(a+b+c+e+1) - lgamma(a+1) - lgamma(b+1) - lgamma(c+1) - lgamma(e+1), 6) AS ln_mass FROM t")
def hypergeometric_masses(spark, d):
    line = b.table(spark, d, "lineitem")
    alt, fwd = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    t = (
        line.groupBy(F.col("l_partkey").alias("pos"))
        .agg(
            F.count_if(alt & fwd).alias("a"), F.count_if(alt & ~fwd).alias("b"), F.count_if(~alt & fwd).alias("c"),
            F.count_if(~alt & ~fwd).alias("e"),
        )
    )
    return t.select("pos", F.round(stats.ln_hypergeometric(*(F.col(c) for c in "abce")), 6).alias("ln_mass"))


#: Of every read and site, the read's own line there if it has one, else the reference; other differences that overlap the site count as neither.
MATRIX = f"""e AS (SELECT DISTINCT l_suppkey % 40 AS read_id, s.pos, s.vtype, s.ref_len, s.alt_len, l_quantity < 8 AS low FROM lineitem JOIN ({b.SITE}) s ON l_partkey = s.pos WHERE l_returnflag = 'R'),
 f AS (SELECT pos, vtype, ref_len, alt_len FROM ({b.SITE}) WHERE pos % 3 = 0), r AS (SELECT DISTINCT l_suppkey % 40 AS read_id FROM lineitem)"""


@query(f"""WITH {MATRIX}, own AS (SELECT read_id, pos, min(CAST(low AS INT)) AS low FROM e GROUP BY 1, 2),
 other AS (SELECT DISTINCT f.pos, e.read_id FROM f JOIN e ON f.pos <> e.pos AND e.pos BETWEEN f.pos - 60 AND f.pos + 60 AND CASE WHEN f.vtype = 1 AND e.vtype = 1 THEN f.pos = e.pos WHEN f.vtype = 1 THEN f.pos > e.pos AND f.pos < e.pos + e.ref_len WHEN e.vtype = 1 THEN e.pos > f.pos AND e.pos < f.pos + f.ref_len ELSE f.pos < e.pos + e.ref_len AND e.pos < f.pos + f.ref_len END)
 SELECT f.pos, r.read_id, CASE WHEN own.low = 1 THEN -2 WHEN own.low = 0 THEN 1 WHEN other.pos IS NOT NULL THEN -1 ELSE 0 END AS allele FROM f CROSS JOIN r LEFT JOIN own ON own.pos = f.pos AND own.read_id = r.read_id LEFT JOIN other ON other.pos = f.pos AND other.read_id = r.read_id""")
def read_site_matrix(spark, d):
    """Forty reads that span all sites."""
    from helixloom.plans.germline import matrix
    from helixloom.schemas import SITE_KEY

    at = b.sites(spark, d).select(F.lit("c").alias("contig"), "pos", "vtype", "ref_len", "alt_len", F.lit("").alias("alt_seq"))
    line = (
        b.table(spark, d, "lineitem")
        .select(
            (F.col("l_suppkey") % 40).alias("read_id"), F.col("l_partkey").alias("pos"), "l_returnflag",
            (F.col("l_quantity") < 8).alias("low"),
        )
    )
    events = at.join(line.filter("l_returnflag = 'R'").drop("l_returnflag"), "pos").groupBy(*SITE_KEY, "read_id").agg(F.min("low").alias("low"))
    found = at.filter("pos % 3 = 0").withColumn("site_id", F.col("pos"))
    everyone = line.select("read_id").distinct()
    seen = found.join(F.broadcast(everyone)).join(events, [*SITE_KEY, "read_id"], "left")  # forty reads
    seen = (
        seen.select(
            "contig", "site_id", "read_id", F.col("low").isNotNull().alias("alt"), F.when(F.col("low"), 0).otherwise(255).alias("bq"),
        )
    )
    none = everyone.select(F.lit("c").alias("contig"), "read_id", F.array().cast("array<struct<st:long,en:long,label:int>>").alias("noisy"))
    return matrix(seen, found, none, events, HIFI).select(F.col("site_id").alias("pos"), "read_id", "allele")


@query(f"""WITH t AS (SELECT l_suppkey % 7 AS grp, l_partkey AS var_id, 'r' || l_orderkey AS qname, l_returnflag = 'R' AS alt FROM lineitem), v AS (SELECT DISTINCT grp, var_id FROM t),
 n AS (SELECT grp, var_id, count(DISTINCT qname) AS n, string_agg(DISTINCT qname, ',' ORDER BY qname) AS names FROM t WHERE alt GROUP BY 1, 2) SELECT v.grp, v.var_id, CAST(coalesce(n.n, 99) AS BIGINT) AS alt_cov, n.names AS alt_reads FROM v LEFT JOIN n ON v.grp = n.grp AND v.var_id = n.var_id""")
def alt_read_names(spark, d):
    from helixloom.operators.genotype import with_names

    t = (
        b.table(spark, d, "lineitem")
        .select(
            (F.col("l_suppkey") % 7).alias("grp"), F.col("l_partkey").alias("var_id"), F.concat(F.lit("r"), "l_orderkey").alias("qname"),
            (F.col("l_returnflag") == "R").alias("alt"),
        )
    )
    v = t.select("grp", "var_id").distinct().withColumn("alt_cov", F.lit(99).cast("long"))
    return with_names(v, t.filter("alt"), ["grp", "var_id"]).withColumn("alt_cov", F.col("alt_cov").cast("long"))



# The whole path ----------------------------------------------------------------------------------------------------------

#: A passage, a repeat of AC, the passage's reverse complement; half of the reads have other bases at every 50th place of the passage and lack the first AC.
@query(f"""{SEQ}, t AS (SELECT id, replace(seq, 'N', 'A') AS seq FROM s), p AS (SELECT id, seq, pos, substr(seq, CAST(pos AS INT), 1) AS ref FROM (SELECT id, seq, unnest(generate_series(50, length(seq) - 10, 50)) AS pos FROM t)),
 v AS (SELECT id, pos, ref, translate(ref, 'ACGT', 'CGTA') AS alt FROM p UNION ALL SELECT id, length(seq) + 1, 'GAC', 'G' FROM t)
 SELECT 'c' || id AS contig, pos, ref, alt, true AS het, 1 AS phases, 12 AS dp, 6 AS alt_ad, 60 AS qual, 60 AS gq FROM v""")
def germline_repeats(spark, d):
    """Indels in repeats on the whole path: noisy regions, extension, consensus of haplotypes, re-alignment, phasing together with clean sites."""
    from helixloom.plans import germline

    first = b.sequences(spark, d).select(F.concat(F.lit("c"), "id").alias("contig"), F.translate("seq", "N", "A").alias("first"))
    s = (
        first.withColumn(
            "seq", F.concat("first", F.lit("G"), F.repeat(F.lit("AC"), F.lit(12)), F.lit("T"), seq.reverse_complement(F.col("first"))),
        )
    )
    n = F.greatest(F.floor((F.length("first") - 10) / 50).cast("int"), F.lit(0))
    other = (
        F.array_join(
            F.transform(F.split("first", ""), lambda c, i: F.when((i % 50 == 49) & (i < F.length("first") - 10), F.translate(c, "ACGT", "CGTA")).otherwise(c)),
            "",
        )
    )
    rest = F.concat(F.repeat(F.lit("AC"), F.lit(11)), F.lit("T"), seq.reverse_complement(F.col("first")))
    cigar = F.concat(F.repeat(F.lit("49=1X"), n), F.length("first") - n * 50 + 1, F.lit("=2D"), F.length("first") + 23, F.lit("="))
    r = s.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(11))))
    odd = F.col("r") % 2 == 1
    reads_ = r.select(
        F.concat(F.lit("r"), "r").alias("qname"), F.when(F.col("r") % 4 < 2, 0).otherwise(16).alias("flag"), "contig", F.lit(1).cast("long").alias("pos"), F.lit(60).alias("mapq"),
        F.when(odd, cigar).otherwise(F.concat(F.length("seq"), F.lit("="))).alias("cigar"), F.when(odd, F.concat(other, F.lit("G"), rest)).otherwise(F.col("seq")).alias("seq"),
        F.lit(None).cast("binary").alias("qual"), F.create_map().cast("map<string,string>").alias("tags"),
    )
    calls, _ = (
        germline.call(
            reads_, s.select("contig", F.length("seq").cast("long").alias("length")), fasta.binned(s.select("contig", "seq")), HIFI,
        )
    )
    phases = F.size(F.collect_set("gt").over(Window.partitionBy("contig", "ps"))).alias("phases")
    return calls.select("contig", "pos", "ref", "alt", F.col("gt").isin("0|1", "1|0").alias("het"), phases, "dp", "alt_ad", "qual", "gq")
