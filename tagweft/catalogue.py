"""The registered queries over reads derived from the shared tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dna
from .operators import chemistry, chimera, matrix, molecules, nearest, scaffold, umi
from .plans import run as plan
from .sinks import fastq as fastq_sink
from .sinks import tables
from .sources import derived, fastq, lines, lists
from .storage import new_path, stored

LAYOUT = molecules.Layout(derived.CELL, derived.UMI, derived.FEATURE)
KEYS = ["category", "cell_id", "feature_id", "umi", "reads"]


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.reads(spark, sf_dir).select("read1", "read2")


def _assigned(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    parts = molecules.pieces(_reads(spark, sf_dir), LAYOUT)
    return molecules.assigned(parts, derived.cells(spark), derived.features(spark), LAYOUT, exact)


def derive_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir)


def molecules_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return molecules.molecules(_assigned(spark, sf_dir, exact=True), LAYOUT).select(KEYS)


def molecules_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return molecules.molecules(_assigned(spark, sf_dir), LAYOUT).select(KEYS)


def _molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(molecules_nearest(spark, sf_dir), "molecules")


def cell_nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _reads(spark, sf_dir).select(F.substring("read1", 1, derived.CELL).alias("barcode"))
    return nearest.match(keys, derived.cells(spark), derived.CELL, 1).select("barcode", F.col("id").alias("cell_id"), "dist")


def feature_nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _reads(spark, sf_dir).select(F.col("read2").alias("barcode"))
    return nearest.match(keys, derived.features(spark), derived.FEATURE, 2).select("barcode", F.col("id").alias("feature_id"), "dist")


def ambiguous_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all strings within two places of the feature barcodes."""
    return nearest.list_facts(derived.features(spark), derived.FEATURE, 2)


def wildcard_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return umi.neighbours(_molecules(spark, sf_dir)).select("category", "cell_id", "feature_id", "umi_a", "umi_b")


def umi_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return umi.numbered(_molecules(spark, sf_dir)).select(*KEYS, "rk")


def _corrected(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return umi.correct(_molecules(spark, sf_dir), method).select(KEYS)

    return query


umi_directional = _corrected("directional")


def count_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chimera.count_cutoff(umi_directional(spark, sf_dir), 3)


def chimeric_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chimera.chimeric_filter(umi_directional(spark, sf_dir), 1, 0.2)


def count_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.dense(matrix.counts(umi_directional(spark, sf_dir))).select("category", "cell_idx", "cell_id", "feature_id", "n")


def csr_indptr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.row_pointers(matrix.counts(umi_directional(spark, sf_dir)))


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return molecules.counters(_assigned(spark, sf_dir), LAYOUT)


def step_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _molecules(spark, sf_dir)
    done = stored(umi.directional(raw), "corrected")
    filtered = chimera.chimeric_filter(done.where("category = 'guide'"), 1, 0.2)
    return matrix.summary(raw, "raw").union(matrix.summary(done, "umi_correct")).union(matrix.summary(filtered, "chimeric_filtered"))


def kept_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _molecules(spark, sf_dir)
    return matrix.kept_ratios(matrix.summary(raw, "raw"), matrix.summary(umi.directional(raw), "umi_correct"))


def barcode_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_cell = molecules_exact(spark, sf_dir).groupBy("cell_id").agg(F.count("*").alias("n"))
    return per_cell.join(derived.cells(spark).select(F.col("id").alias("cell_id"), "name"), "cell_id").select("name", "n")


def category_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = derived.features(spark).select(F.col("id").alias("ordinal"), "barcode", F.concat("name", F.lit(","), "category").alias("name"))
    return lists.with_categories(listed, "").select(F.col("id").alias("feature_id"), "name", "category")


def feature_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(k,) for k in ("crispr", "hashing", "citeseq", "antibody", "cmo", "adt", "hash")], "kind string")
    return kinds.select("kind", dna.type_label(F.col("kind")).alias("label"))


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.reads(spark, sf_dir).select(F.lit(0).alias("file_id"), (F.col("read_key") * 8 + F.col("line_no")).alias("ordinal"), "read1", "read2")


def chemistry_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lists: all cells, every second, and none of them."""
    cells = derived.cells(spark)
    every = cells.select(F.lit("whole").alias("chem"), "barcode").union(cells.where("id % 2 = 0").select(F.lit("half"), "barcode")).union(cells.select(F.lit("other"), dna.reverse_complement(F.col("barcode"))))
    return chemistry.votes(chemistry.first_reads(_ordered(spark, sf_dir)), every, derived.CELL)


def position_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = chemistry.first_reads(_ordered(spark, sf_dir))
    moved = sample.withColumn("read2", F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("ACGTACGTAC"), "read2")).otherwise(F.col("read2")))
    return chemistry.position_votes(moved, derived.features(spark), derived.FEATURE, 2)


def scaffold_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scaffold.anchored(derived.scaffold_reads(spark, sf_dir), derived.SCAFFOLD, derived.FEATURE, 2)
    return found.select("read_key", "line_no", "start", "feature_barcode")


def encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _reads(spark, sf_dir).select(F.col("read2").alias("barcode")).distinct()
    code = dna.encode(F.col("barcode"))
    return keys.select("barcode", code.alias("code"), dna.decode(code, derived.FEATURE).alias("roundtrip"), dna.reverse_complement(F.col("barcode")).alias("rc"))


def _records(rows: DataFrame) -> DataFrame:
    """(read1, read2) of derived reads as structs, with a name for each pair."""
    name = F.concat_ws(":", F.col("read_key").cast("string"), F.col("line_no").cast("string"))

    def mate(n: int) -> Column:
        seq = F.col(f"read{n}")
        return F.struct(name.alias("name"), F.lit(str(n)).alias("comment"), seq.alias("seq"), F.rpad(F.lit(""), F.length(seq), F.lit("I")).alias("qual")).alias(f"read{n}")

    return rows.select("read_key", "line_no", mate(1), mate(2))


def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as pairs of gzip files, and read back by the data source."""
    folder = new_path(spark, "fastq")
    fastq_sink.write_pairs(_records(derived.reads(spark, sf_dir)), folder)
    return fastq.read_pairs(spark, folder).select("name1", "comment1", "read1", "qual1", "name2", "comment2", "read2", "qual2")


def fastq_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As fastq_round_trip, read through Hadoop's file systems; counted by file, as their number depends on the cores."""
    folder = new_path(spark, "fastq")
    fastq_sink.write_pairs(_records(derived.reads(spark, sf_dir)), folder)
    got = fastq.pairs_of_lines(spark, folder)
    return got.groupBy(F.substring("read1", 1, 2).alias("start")).agg(F.count("*").alias("reads"), F.count_distinct("file_id", "ordinal").alias("places"), F.sum(F.length("read2")).alias("bases"))


def bgzf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All first reads as one BGZF file, in order, read back as text."""
    path = f"{new_path(spark, 'bgzf')}/reads.bgz"
    rows = derived.reads(spark, sf_dir).orderBy("read_key", "line_no")
    fastq_sink.write_bgzf(_records(rows).select(F.col("read1").alias("read")), path)
    found = lines.bgzf_lines(spark, path)
    return found.groupBy((F.col("line_no") % 4).alias("line_of_record")).agg(F.count("*").alias("lines"), F.min("line").alias("least"), F.max("line").alias("most"), F.min_by("line", "line_no").alias("first"), F.max_by("line", "line_no").alias("last"))


def list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature list written as gzip text, with a byte order mark, blanks and empty lines, and read back."""
    path = new_path(spark, "list")
    line = F.concat(F.when(F.col("id") == 0, "\ufeff").otherwise(""), F.lit(" "), "barcode", F.lit(" , "), "name", F.lit(","), "category", F.when(F.col("id") == 3, "\r\n \n").otherwise("\r"))
    rows = derived.features(spark).orderBy("id").coalesce(1).select(line.alias("value"))
    rows.write.option("compression", "gzip").text(path)
    return lists.feature_list(spark, path, "none").select(F.col("id").alias("feature_id"), "barcode", "name", "category")


def short_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules where some first reads lack their last bases: all UMIs are as long as the shortest allows."""
    lost = F.when(F.col("read_key") % 97 == 1, 3).when(F.col("read_key") % 97 == 2, 2).otherwise(0)
    reads = derived.reads(spark, sf_dir).select(F.substring("read1", F.lit(1), F.length("read1") - lost).alias("read1"), "read2")
    found = stored(molecules.assigned(molecules.pieces(reads, LAYOUT), derived.cells(spark), derived.features(spark), LAYOUT, exact=True), "assigned")
    return molecules.molecules(found, LAYOUT, molecules.shortest_umi(found, LAYOUT)).select(KEYS)


def matrix_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of exact matches written as tables, and read back with names."""
    path = new_path(spark, "matrix")
    features = derived.features(spark)
    tables.write_matrix(molecules_exact(spark, sf_dir), derived.cells(spark), features, path)
    entries, rows, columns = (spark.read.parquet(f"{path}/{part}") for part in ("entries", "barcodes", "features"))
    named = entries.join(rows.withColumnRenamed("name", "cell"), ["category", "cell_idx"])
    return named.join(columns.select(F.col("id").alias("feature_id"), F.col("name").alias("feature"), "feature_type"), "feature_id").select("category", "cell_idx", "cell", "feature", "feature_type", "n")


def molecule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules of exact matches written by step and category, and read back."""
    path = new_path(spark, "molecules")
    tables.write_molecules(molecules_exact(spark, sf_dir).withColumn("step", F.lit("raw")), path)
    return spark.read.parquet(path).select("step", *KEYS)


def market_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of exact matches in MatrixMarket files: each category's lines in order."""
    path = new_path(spark, "market")
    own = tables.write_market(molecules_exact(spark, sf_dir), derived.cells(spark), derived.features(spark), path)
    every = None
    for folder in own:
        text = spark.read.text(f"{folder}/matrix.mtx").select(F.lit(folder.rsplit("/", 1)[-1]).alias("category"), F.col("value").alias("line"))
        every = text if every is None else every.union(text)
    return every


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report of a whole run, but for its seconds; guides take the chimeric filter."""
    features = derived.features(spark)
    options = plan.Options(count_cutoff=1, read_ratio=0.2, crispr=frozenset({"guide"}))
    result = plan.run(_reads(spark, sf_dir), derived.cells(spark), features, LAYOUT, options)

    def rows(frame: DataFrame) -> list[dict]:
        return [r.asDict() for r in frame.collect()]  # a row a step and category

    facts = tables.list_text("Features", nearest.list_facts(features, derived.FEATURE, 2).first().asDict())
    steps = ["raw", "umi_correct", "chimeric_filtered"]
    sections = sorted(rows(result.summaries), key=lambda r: (r["category"], steps.index(r["step"])))
    text = tables.report_text(result.counters.first().asDict(), sections, rows(result.kept), facts)
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line_no int, line string")


def chemistry_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each chemistry option stands for."""
    rows = []
    for option in [*chemistry.COMPOUND, *chemistry.LISTS, "unknown"]:
        try:
            rows += [(option, name, chemistry.LISTS[name], *chemistry.lengths(name)) for name in chemistry.candidates(option)]
        except ValueError:
            rows.append((option, None, None, None, None))
    return spark.createDataFrame(rows, "option string, name string, file string, umi_length int, cell_mismatch int")


def chemistry_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which list wins for given numbers of matches."""
    rows = []
    for one, two in product((0, 3, 499, 500, 1000, 1499, 1500, 2000), repeat=2):
        try:
            rows.append((one, two, chemistry.decide({"one": one, "two": two})))
        except ValueError:
            rows.append((one, two, None))
    return spark.createDataFrame(rows, "one int, two int, chosen string")


def detection_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision for each chemistry, feature type, position, scaffold and vote."""
    rows = []
    for case in product(chemistry.LISTS, (*chemistry.FEATURE_TYPES, "antibody"), (-1, 5), ("", derived.SCAFFOLD), ((20, 3), (3, 20), (20, 20), (9, 9))):
        name, kind, given, pattern, counts = case
        try:
            c = chemistry.resolved(name, kind, given, pattern, *counts)
            rows.append((name, kind, given, pattern, *counts, c.name, c.umi_length, c.cell_mismatch, c.totalseq, c.feature_start))
        except ValueError:
            rows.append((name, kind, given, pattern, *counts, None, None, None, None, None))
    return spark.createDataFrame(rows, "name string, feature_type string, given int, scaffold string, n_pos0 int, n_pos10 int, chemistry string, umi_length int, cell_mismatch int, totalseq string, feature_start int")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (derive_reads, molecules_exact, molecules_nearest, cell_nearest_match, feature_nearest_match, ambiguous_keys, wildcard_neighbours, umi_rank, count_cutoff, chimeric_filter, count_matrix, csr_indptr, run_counters, step_report, kept_ratios, barcode_translation, category_renumber, feature_labels, chemistry_vote, position_vote, scaffold_locate, encode_decode, fastq_round_trip, fastq_remote, bgzf_file, list_round_trip, short_reads, matrix_files, molecule_files, market_files, report_lines, chemistry_lists, chemistry_accept, detection_rules)
} | {f"umi_{m}": _corrected(m) for m in ("cluster", "adjacency", "directional")}

_DNA = "translate(md5({}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _tag(prefix: str, number: str, length: int) -> str:
    text = f"'{prefix}' || CAST({number} AS VARCHAR)"
    return f"substr({_DNA.format(text)}, 1, {length})"


def _put(column: str, place: str) -> str:
    return f"substr({column}, 1, {place} - 1) || base || substr({column}, {place} + 1)"


_LISTS = f"""
cells AS (SELECT i::INT AS id, {_tag('cell', 'i', 16)} AS barcode, 'name' || i AS name FROM range(32) t(i)),
features AS (SELECT i::INT AS id, {_tag('feat', 'i', 15)} AS barcode, 'tag' || i AS name, CASE WHEN i % 2 = 0 THEN 'hash' ELSE 'guide' END AS category FROM range(8) t(i))"""
_READS = f"""
tags AS (SELECT l_orderkey AS k, l_linenumber AS ln, substr('ACGTN', (l_orderkey % 5 + 1)::INT, 1) AS base,
  {_tag('cell', '(l_suppkey % 32)', 16)} AS c, {_tag('umi', '((l_orderkey * 7 + l_linenumber) % 40)', 12)} AS u, {_tag('feat', '(l_partkey % 8)', 15)} AS f FROM lineitem),
reads AS (SELECT k, ln, CASE WHEN k % 7 = 0 THEN {_put('c', '(ln + 1)')} ELSE c END || CASE WHEN k % 3 = 0 THEN {_put('u', '(ln + 2)')} ELSE u END AS read1,
  CASE WHEN k % 6 = 0 THEN {_put('f', '(ln + 3)')} ELSE f END AS read2 FROM tags),{_LISTS}"""


def _match(keys: str, listed: str, radius: str, name: str) -> str:
    return f"""
{name}_near AS (SELECT barcode, id, hamming(barcode, listed)::INT AS dist FROM (SELECT DISTINCT {keys} AS barcode FROM reads) CROSS JOIN (SELECT id, barcode AS listed FROM {listed})),
{name}_best AS (SELECT barcode, id, dist, count(*) OVER (PARTITION BY barcode, dist) AS ids, min(dist) OVER (PARTITION BY barcode) AS least FROM {name}_near),
{name} AS (SELECT barcode, id, dist FROM {name}_best WHERE dist = least AND ids = 1 AND dist <= {radius})"""


_RADIUS = """
one AS (SELECT f.id, substr(f.barcode, 1, p - 1) || c || substr(f.barcode, p + 1) AS q FROM features f CROSS JOIN (SELECT unnest(range(1, 16)) AS p) CROSS JOIN (SELECT unnest(['A','C','G','T','N']) AS c)),
radius AS (SELECT CASE WHEN EXISTS (SELECT q FROM one WHERE q NOT IN (SELECT barcode FROM features) GROUP BY q HAVING count(DISTINCT id) > 1) THEN 1 ELSE 2 END AS r)"""
_MATCHED = f"""{_READS},{_match('substr(read1, 1, 16)', 'cells', '1', 'cm')},{_RADIUS},{_match('read2', 'features', '(SELECT r FROM radius)', 'fm')},
assigned AS (SELECT cm.id AS cell_id, fm.id AS feature_id, features.category, substr(read1, 17, 12) AS umi FROM reads LEFT JOIN cm ON cm.barcode = substr(read1, 1, 16) LEFT JOIN fm ON fm.barcode = read2 LEFT JOIN features ON features.id = fm.id)"""
_MOLECULES = f"""{_MATCHED},
mol AS (SELECT category, cell_id, feature_id, umi, count(*) AS reads FROM assigned WHERE cell_id IS NOT NULL AND feature_id IS NOT NULL AND umi NOT LIKE '%N%' GROUP BY ALL)"""
_EXACT = f"""{_READS},
mol AS (SELECT f.category, c.id AS cell_id, f.id AS feature_id, substr(read1, 17, 12) AS umi, count(*) AS reads FROM reads JOIN cells c ON c.barcode = substr(read1, 1, 16) JOIN features f ON f.barcode = read2 WHERE substr(read1, 17, 12) NOT LIKE '%N%' GROUP BY ALL)"""
_RANKED = f"""{_MOLECULES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY category, cell_id, feature_id ORDER BY reads DESC, reverse(umi)) AS rk FROM mol),
near AS (SELECT a.category, a.cell_id, a.feature_id, a.umi AS umi_a, a.reads AS reads_a, a.rk AS rk_a, b.umi AS umi_b, b.reads AS reads_b, b.rk AS rk_b
  FROM ranked a JOIN ranked b USING (category, cell_id, feature_id) WHERE hamming(a.umi, b.umi) = 1)"""


def _labels(condition: str) -> str:
    return f"""{_RANKED},
reach(category, cell_id, feature_id, rk, label) AS (
  SELECT category, cell_id, feature_id, rk, rk FROM ranked UNION
  SELECT n.category, n.cell_id, n.feature_id, n.rk_b, r.label FROM reach r JOIN near n ON n.category = r.category AND n.cell_id = r.cell_id AND n.feature_id = r.feature_id AND n.rk_a = r.rk WHERE {condition}),
labelled AS (SELECT category, cell_id, feature_id, rk, min(label) AS label FROM reach GROUP BY ALL)"""


_SUM = """
SELECT m.category, m.cell_id, m.feature_id, t.umi, sum(m.reads)::BIGINT AS reads
FROM ranked m JOIN {} l USING (category, cell_id, feature_id, rk) JOIN ranked t ON t.category = m.category AND t.cell_id = m.cell_id AND t.feature_id = m.feature_id AND t.rk = l.{}
GROUP BY ALL"""
_EDGE = "(reads_a > 1 AND reads_a >= 2 * reads_b - 1) OR (reads_a = 1 AND reads_b = 1)"
_DIRECTIONAL = f"WITH RECURSIVE {_labels(_EDGE)}, done AS ({_SUM.format('labelled', 'label')})"
_SUMMARY = """SELECT '{}' AS step, category, count(DISTINCT cell_id) AS cells, count(*) AS umis, sum(reads)::BIGINT AS reads,
  round(sum(reads)::DOUBLE / count(DISTINCT cell_id), 2) AS reads_per_cell, round(count(*)::DOUBLE / count(DISTINCT cell_id), 2) AS umis_per_cell,
  round(100.0::DOUBLE - 100.0::DOUBLE * count(*) / sum(reads), 2) AS saturation FROM {} GROUP BY category"""
_FILTERED = """filtered AS (SELECT category, cell_id, feature_id, umi, reads FROM (SELECT *, sum(reads) OVER (PARTITION BY category, cell_id, umi) AS total FROM done WHERE reads > 1)
  WHERE reads::FLOAT > 0.2::FLOAT * total::FLOAT)"""
_FIRST = "first AS (SELECT * FROM reads ORDER BY k * 8 + ln LIMIT 10000)"

_FACTS = """
letters AS (SELECT unnest(['A','C','G','T','N']) AS c), spots AS (SELECT unnest(range(1, 16)) AS p),
once AS (SELECT DISTINCT id, barcode, substr(barcode, 1, p - 1) || c || substr(barcode, p + 1) AS q FROM features, spots, letters),
twice AS (SELECT DISTINCT id, barcode, substr(q, 1, p - 1) || c || substr(q, p + 1) AS q FROM once, spots, letters),
nearest AS (SELECT q, dist, count(*) AS ids FROM (SELECT q, hamming(q, barcode) AS dist, min(hamming(q, barcode)) OVER (PARTITION BY q) AS least FROM twice) WHERE dist = least GROUP BY ALL),
limits AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM nearest WHERE dist = 1 AND ids > 1) THEN 1 ELSE 2 END AS r),
facts AS (SELECT (SELECT count(*) FROM features) AS barcodes, 15 AS length, count(*) AS n_keys, count(*) FILTER (ids > 1) AS n_ambiguous,
  round(100.0::DOUBLE * count(*) FILTER (ids > 1) / count(*), 2) AS ambiguous_share FROM nearest WHERE dist <= (SELECT r FROM limits))"""


def _tail(at: str) -> str:
    """Fewest edits between the scaffold after its first base and a stretch of the read from a 0-based place."""
    rest = derived.SCAFFOLD[1:]
    fits = [f"CASE WHEN length(r) >= {at} + {n} THEN levenshtein(substr(r, {at} + 1, {n}), '{rest}') END" for n in range(len(rest) - 2, len(rest) + 3)]
    return f"coalesce(least({', '.join(fits)}), 3)"


_SCAFFOLD = derived.SCAFFOLD
_LOCATED = f"""{_READS},
shaped AS (SELECT k AS read_key, ln AS line_no, substr({_DNA.format("'pre' || CAST(k % 64 AS VARCHAR)")}, 1, 10) || read2 || CASE k % 4 WHEN 0 THEN '{_SCAFFOLD}'
  WHEN 1 THEN substr('{_SCAFFOLD}', 1, ln + 2) || substr('{_SCAFFOLD}', ln + 4) WHEN 2 THEN substr('{_SCAFFOLD}', 1, ln + 2) || 'C' || substr('{_SCAFFOLD}', ln + 3)
  ELSE substr('{_SCAFFOLD}', 1, ln + 2) || 'T' || substr('{_SCAFFOLD}', ln + 4) END AS r FROM reads),
spots AS (SELECT r, s::INT AS s FROM (SELECT DISTINCT r FROM shaped), range(13, 60) t(s) WHERE s <= length(r) - 18 + 4),
priced AS (SELECT r, s, least(CASE WHEN substr(r, s + 1, 1) = '{_SCAFFOLD[0]}' THEN 0 ELSE 1 END + {_tail('(s + 1)')}, {_tail('s')} + 1, 3) AS c FROM spots),
opened AS (SELECT r, min(s) AS s FROM priced WHERE c <= 2 AND s <= length(r) - 18 GROUP BY r),
one AS (SELECT o.r, p.s, p.c FROM opened o JOIN priced p USING (r, s)),
two AS (SELECT one.r, coalesce(min(p.s), any_value(one.s)) AS s FROM one LEFT JOIN priced p ON p.r = one.r AND p.s > one.s AND p.s <= one.s + 2 AND p.c < one.c GROUP BY one.r),
two_c AS (SELECT two.r, p.s, p.c, one.s AS before FROM two JOIN priced p USING (r, s) JOIN one ON one.r = two.r),
three AS (SELECT t.r, coalesce(min(p.s), any_value(t.s)) AS s FROM two_c t LEFT JOIN priced p ON p.r = t.r AND t.s > t.before AND p.s > t.s AND p.s <= t.s + 2 AND p.c < t.c GROUP BY t.r),
found AS (SELECT r, s FROM three WHERE s <= length(r) - 18)"""
_NAMES = ", ".join(f"('{name}', '{file}')" for name, file in chemistry.LISTS.items())
_V2 = "name IN ('10x_v2', 'SC3Pv2', 'SC5Pv2')"
_RULES = f"""names(name, file) AS (VALUES {_NAMES}),
rules AS (SELECT *, CASE WHEN {_V2} THEN 10 ELSE 12 END AS umi_length, CASE WHEN {_V2} OR name = 'multiome' THEN 1 ELSE 0 END AS cell_mismatch FROM names)"""
_QUALITY = "repeat('I', length({}))"
_NUMBERS = {"n_valid_cell": "valid cell barcodes", "n_valid_feature": "valid feature barcodes", "n_valid": "valid cell and feature barcodes", "n_valid_umi": "valid barcodes and UMI"}

ORACLE_SQL = {
    "derive_reads": f"WITH {_READS} SELECT read1, read2 FROM reads",
    "molecules_exact": f"WITH {_EXACT} SELECT * FROM mol",
    "molecules_nearest": f"WITH {_MOLECULES} SELECT * FROM mol",
    "cell_nearest_match": f"WITH {_MATCHED} SELECT barcode, id AS cell_id, dist FROM cm",
    "feature_nearest_match": f"WITH {_MATCHED} SELECT barcode, id AS feature_id, dist FROM fm",
    "ambiguous_keys": f"""WITH {_LISTS}, {_FACTS} SELECT * FROM facts""",
    "wildcard_neighbours": f"WITH {_RANKED} SELECT category, cell_id, feature_id, umi_a, umi_b FROM near",
    "umi_rank": f"WITH {_RANKED} SELECT * FROM ranked",
    "umi_cluster": f"WITH RECURSIVE {_labels('true')} {_SUM.format('labelled', 'label')}",
    "umi_directional": f"{_DIRECTIONAL} SELECT * FROM done",
    "umi_adjacency": f"""WITH RECURSIVE {_labels('true')},
best AS (SELECT r.category, r.cell_id, r.feature_id, r.rk, least(r.rk, coalesce(min(n.rk_a), r.rk)) AS edge FROM ranked r LEFT JOIN near n ON n.category = r.category AND n.cell_id = r.cell_id AND n.feature_id = r.feature_id AND n.rk_b = r.rk GROUP BY r.category, r.cell_id, r.feature_id, r.rk),
lasts AS (SELECT *, max(edge) OVER (PARTITION BY category, cell_id, feature_id, label) AS last FROM best JOIN labelled USING (category, cell_id, feature_id, rk)),
goal AS (SELECT category, cell_id, feature_id, rk, CASE WHEN rk <= last THEN rk ELSE edge END AS target FROM lasts) {_SUM.format('goal', 'target')}""",
    "count_cutoff": f"{_DIRECTIONAL} SELECT * FROM done WHERE reads > 3",
    "chimeric_filter": f"{_DIRECTIONAL}, {_FILTERED} SELECT * FROM filtered",
    "count_matrix": f"{_DIRECTIONAL}, m AS (SELECT category, cell_id, feature_id, count(*) AS n FROM done GROUP BY ALL) SELECT category, dense_rank() OVER (PARTITION BY category ORDER BY cell_id) - 1 AS cell_idx, cell_id, feature_id, n FROM m",
    "csr_indptr": f"""{_DIRECTIONAL}, m AS (SELECT category, cell_id, count(DISTINCT feature_id) AS e FROM done GROUP BY ALL)
SELECT category, row_number() OVER w - 1 AS cell_idx, (sum(e) OVER (PARTITION BY category ORDER BY cell_id ROWS UNBOUNDED PRECEDING))::BIGINT AS indptr FROM m WINDOW w AS (PARTITION BY category ORDER BY cell_id)""",
    "run_counters": f"""WITH {_MATCHED} SELECT count(*) AS n_reads, count(*) FILTER (cell_id IS NOT NULL) AS n_valid_cell, count(*) FILTER (feature_id IS NOT NULL) AS n_valid_feature,
count(*) FILTER (cell_id IS NOT NULL AND feature_id IS NOT NULL) AS n_valid, count(*) FILTER (cell_id IS NOT NULL AND feature_id IS NOT NULL AND umi NOT LIKE '%N%') AS n_valid_umi FROM assigned""",
    "step_report": f"{_DIRECTIONAL}, {_FILTERED} {_SUMMARY.format('raw', 'mol')} UNION ALL {_SUMMARY.format('umi_correct', 'done')} UNION ALL {_SUMMARY.format('chimeric_filtered', chr(40) + 'SELECT * FROM filtered WHERE category = ' + chr(39) + 'guide' + chr(39) + chr(41))}",
    "kept_ratios": f"""{_DIRECTIONAL}, a AS (SELECT category, count(*) AS u, count(DISTINCT cell_id) AS c FROM mol GROUP BY 1), b AS (SELECT category, count(*) AS u, count(DISTINCT cell_id) AS c FROM done GROUP BY 1)
SELECT category, 'umi_correct' AS step, round(100.0::DOUBLE * b.u / a.u, 2) AS umis_kept, round(100.0::DOUBLE * b.c / a.c, 2) AS cells_kept FROM a JOIN b USING (category)""",
    "barcode_translation": f"WITH {_EXACT} SELECT name, count(*) AS n FROM mol JOIN cells ON cells.id = cell_id GROUP BY name",
    "category_renumber": f"WITH {_LISTS} SELECT (row_number() OVER (ORDER BY category, id) - 1)::INT AS feature_id, name, category FROM features",
    "feature_labels": """SELECT kind, CASE kind WHEN 'crispr' THEN 'CRISPR Guide Capture' WHEN 'hashing' THEN 'Multiplexing Capture' WHEN 'citeseq' THEN 'Antibody Capture' WHEN 'antibody' THEN 'Antibody Capture' ELSE 'Custom' END AS label
FROM (SELECT unnest(['crispr','hashing','citeseq','antibody','cmo','adt','hash']) AS kind)""",
    "chemistry_vote": f"""WITH {_READS}, {_FIRST}, lists AS (SELECT 'whole' AS chem, barcode FROM cells UNION ALL SELECT 'half', barcode FROM cells WHERE id % 2 = 0 UNION ALL SELECT 'other', reverse(translate(barcode, 'ACGTN', 'TGCAN')) FROM cells),
v AS (SELECT chem, count(k) AS n_match FROM lists LEFT JOIN first ON substr(read1, 1, 16) = barcode GROUP BY chem) SELECT chem, n_match, row_number() OVER (ORDER BY n_match DESC, chem) AS rank FROM v""",
    "position_vote": f"""WITH {_READS}, {_FIRST}, {_RADIUS}, moved AS (SELECT CASE WHEN (k * 8 + ln) % 3 = 0 THEN 'ACGTACGTAC' || read2 ELSE read2 END AS r2 FROM first),
spots AS (SELECT 0 AS pos, substr(r2, 1, 15) AS q FROM moved UNION ALL SELECT 10, substr(r2, 11, 15) FROM moved WHERE length(r2) >= 25),
d AS (SELECT DISTINCT q, id, hamming(q, barcode) AS dist FROM spots, features), best AS (SELECT q, min(dist) AS least FROM d GROUP BY q),
ok AS (SELECT q FROM d JOIN best USING (q) WHERE dist = least AND dist <= (SELECT r FROM radius) GROUP BY q HAVING count(*) = 1)
SELECT count(*) FILTER (pos = 0) AS n_pos0, count(*) FILTER (pos = 10) AS n_pos10 FROM spots JOIN ok USING (q)""",
    "encode_decode": f"""WITH {_READS}, keys AS (SELECT DISTINCT read2 AS barcode FROM reads)
SELECT barcode, list_sum([(instr('ACGTN', substr(barcode, i::INT, 1)) - 1)::BIGINT << ((i - 1) * 3)::BIGINT for i in range(1, length(barcode) + 1)])::BIGINT AS code, barcode AS roundtrip, reverse(translate(barcode, 'ACGTN', 'TGCAN')) AS rc FROM keys""",
    "scaffold_locate": f"""WITH {_LOCATED} SELECT read_key, line_no, found.s AS start, CASE WHEN found.s IS NOT NULL THEN lpad(substr(shaped.r, greatest(found.s - 15, 0) + 1, least(found.s, 15)), 15, 'N') END AS feature_barcode FROM shaped LEFT JOIN found USING (r)""",
    "fastq_round_trip": f"""WITH {_READS} SELECT k || ':' || ln AS name1, '1' AS comment1, read1, {_QUALITY.format('read1')} AS qual1, k || ':' || ln AS name2, '2' AS comment2, read2, {_QUALITY.format('read2')} AS qual2 FROM reads""",
    "fastq_remote": f"WITH {_READS} SELECT substr(read1, 1, 2) AS start, count(*) AS reads, count(*) AS places, sum(length(read2))::BIGINT AS bases FROM reads GROUP BY 1",
    "bgzf_file": f"""WITH {_READS}, lines AS (SELECT k, ln, unnest([0, 1, 2, 3])::BIGINT AS line_of_record, unnest(['@' || k || ':' || ln || ' 1', read1, '+', {_QUALITY.format('read1')}]) AS line FROM reads)
SELECT line_of_record, count(*) AS lines, min(line) AS least, max(line) AS most, arg_min(line, (k, ln)) AS first, arg_max(line, (k, ln)) AS last FROM lines GROUP BY 1""",
    "list_round_trip": f"WITH {_LISTS} SELECT (row_number() OVER (ORDER BY category, id) - 1)::INT AS feature_id, barcode, name, category FROM features",
    "short_reads": f"""WITH {_READS}, cut AS (SELECT substr(read1, 1, 28 - CASE k % 97 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END) AS read1, read2 FROM reads),
paired AS (SELECT f.category, c.id AS cell_id, f.id AS feature_id, read1 FROM cut JOIN cells c ON c.barcode = substr(read1, 1, 16) JOIN features f ON f.barcode = read2),
whole AS (SELECT category, cell_id, feature_id, substr(read1, 17, (SELECT least(12, min(length(read1)) - 16) FROM paired)) AS umi FROM paired)
SELECT category, cell_id, feature_id, umi, count(*) AS reads FROM whole WHERE umi NOT LIKE '%N%' GROUP BY ALL""",
    "matrix_files": f"""WITH {_EXACT}, m AS (SELECT category, cell_id, feature_id, count(*) AS n FROM mol GROUP BY ALL)
SELECT m.category, dense_rank() OVER (PARTITION BY m.category ORDER BY cell_id) - 1 AS cell_idx, c.name AS cell, f.name AS feature, 'Custom' AS feature_type, n FROM m JOIN cells c ON c.id = cell_id JOIN features f ON f.id = feature_id""",
    "molecule_files": f"WITH {_EXACT} SELECT 'raw' AS step, * FROM mol",
    "market_files": f"""WITH {_EXACT}, g AS (SELECT category, cell_id, feature_id, count(*) AS n FROM mol GROUP BY ALL), m AS (SELECT *, dense_rank() OVER (PARTITION BY category ORDER BY cell_id) AS line_of FROM g),
place AS (SELECT id, row_number() OVER (PARTITION BY category ORDER BY id) AS spot FROM features)
SELECT category, spot || ' ' || line_of || ' ' || n AS line FROM m JOIN place ON id = feature_id UNION ALL SELECT category, '%%MatrixMarket matrix coordinate integer general' FROM m GROUP BY 1
UNION ALL SELECT category, (SELECT count(*) FROM features f WHERE f.category = m.category) || ' ' || count(DISTINCT cell_id) || ' ' || count(*) FROM m GROUP BY category""",
    "report_lines": f"""{_DIRECTIONAL}, {_FILTERED}, {_FACTS},
numbers AS (SELECT count(*) AS n_reads, count(*) FILTER (cell_id IS NOT NULL) AS n_valid_cell, count(*) FILTER (feature_id IS NOT NULL) AS n_valid_feature,
  count(*) FILTER (cell_id IS NOT NULL AND feature_id IS NOT NULL) AS n_valid, count(*) FILTER (cell_id IS NOT NULL AND feature_id IS NOT NULL AND umi NOT LIKE '%N%') AS n_valid_umi FROM assigned),
summaries AS ({_SUMMARY.format('raw', 'mol')} UNION ALL {_SUMMARY.format('umi_correct', 'done')} UNION ALL {_SUMMARY.format('chimeric_filtered', "(SELECT * FROM filtered WHERE category = 'guide')")}),
sections AS (SELECT s.*, CASE s.step WHEN 'raw' THEN 0 WHEN 'umi_correct' THEN 1 ELSE 2 END AS place, 100.0::DOUBLE * s.umis / r.umis AS umis_kept, 100.0::DOUBLE * s.cells / r.cells AS cells_kept FROM summaries s JOIN summaries r ON r.category = s.category AND r.step = 'raw'),
lines AS (
  SELECT 0 AS a, '' AS b, 0 AS c, 0 AS d, 'Features: ' || barcodes || ' barcodes of 15 bases; ' || n_ambiguous || ' of ' || n_keys || ' index keys are ambiguous (' || printf('%.2f', ambiguous_share) || '%)' AS line FROM facts
  UNION ALL SELECT 1, '', 0, 0, 'Number of reads: ' || n_reads FROM numbers
  {' '.join(f"UNION ALL SELECT 2, '', 0, {i}, 'Reads with {label}: ' || {name} || ' (' || printf('%.2f', 100.0::DOUBLE * {name} / n_reads) || '%)' FROM numbers" for i, (name, label) in enumerate(_NUMBERS.items()))}
  UNION ALL SELECT 3, category, place, i, CASE i WHEN 0 THEN '' WHEN 1 THEN '[' || category || '] ' || step WHEN 2 THEN 'cells: ' || cells WHEN 3 THEN 'umis: ' || umis WHEN 4 THEN 'reads: ' || reads
    WHEN 5 THEN 'reads_per_cell: ' || printf('%.2f', reads_per_cell) WHEN 6 THEN 'umis_per_cell: ' || printf('%.2f', umis_per_cell) WHEN 7 THEN 'saturation: ' || printf('%.2f', saturation)
    WHEN 8 THEN 'umis_kept: ' || printf('%.2f', round(umis_kept, 2)) ELSE 'cells_kept: ' || printf('%.2f', round(cells_kept, 2)) END FROM sections, range(10) t(i) WHERE i < 8 OR step <> 'raw')
SELECT (row_number() OVER (ORDER BY a, b, c, d) - 1)::INT AS line_no, line FROM lines""",
    "chemistry_lists": f"""WITH {_RULES}, options(option, name) AS (VALUES {', '.join(f"('{o}', '{n}')" for o, ns in chemistry.COMPOUND.items() for n in ns)} UNION ALL SELECT name, CASE WHEN name <> '10x_v2' THEN name END FROM names WHERE name NOT IN ('auto') UNION ALL SELECT 'unknown', NULL)
SELECT option, options.name, file, umi_length, cell_mismatch FROM options LEFT JOIN rules ON rules.name = options.name""",
    "chemistry_accept": """WITH n AS (SELECT unnest([0, 3, 499, 500, 1000, 1499, 1500, 2000]) AS v), c AS (SELECT a.v AS one, b.v AS two FROM n a, n b)
SELECT one, two, CASE WHEN greatest(one, two) = 0 THEN NULL WHEN least(one, two) > 0 AND (greatest(one, two) < 500 OR greatest(one, two) - least(one, two) < 1000) THEN NULL WHEN one >= two THEN 'one' ELSE 'two' END AS chosen FROM c""",
    "detection_rules": f"""WITH {_RULES}, cases AS (SELECT rules.*, t.feature_type, g.given, s.scaffold, v.n_pos0, v.n_pos10, t.feature_type IN ('hashing', 'citeseq', 'adt') AS antibody FROM rules, (VALUES ('hashing'), ('citeseq'), ('adt'), ('cmo'), ('crispr'), ('antibody')) t(feature_type),
  (VALUES (-1), (5)) g(given), (VALUES (''), ('{_SCAFFOLD}')) s(scaffold), (VALUES (20, 3), (3, 20), (20, 20), (9, 9)) v(n_pos0, n_pos10)),
kinds AS (SELECT *, CASE WHEN NOT antibody THEN '' WHEN name LIKE '%:Poly-A' THEN 'A' WHEN name LIKE '%:%' THEN 'B' WHEN name = 'SC5Pv3' THEN 'C' WHEN given >= 0 THEN '' WHEN n_pos0 < 10 AND n_pos10 < 10 THEN NULL WHEN n_pos0 > n_pos10 THEN 'A' ELSE 'C' END AS totalseq FROM cases),
decided AS (SELECT *, feature_type <> 'antibody' AND totalseq IS NOT NULL AS ok FROM kinds)
SELECT name, feature_type, given, scaffold, n_pos0, n_pos10, CASE WHEN NOT ok THEN NULL WHEN name = '10x_v2' AND totalseq = 'A' THEN 'SC3Pv2' WHEN name = '10x_v2' AND totalseq = 'C' THEN 'SC5Pv2' ELSE name END AS chemistry,
  CASE WHEN ok THEN umi_length END AS umi_length, CASE WHEN ok THEN cell_mismatch END AS cell_mismatch, CASE WHEN ok THEN totalseq END AS totalseq,
  CASE WHEN NOT ok THEN NULL WHEN antibody THEN CASE totalseq WHEN 'A' THEN 0 ELSE 10 END WHEN feature_type = 'cmo' THEN 0 WHEN given >= 0 THEN given WHEN scaffold = '' THEN 0 ELSE -1 END AS feature_start FROM decided""",
}
