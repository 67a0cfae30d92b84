"""The registered queries of the engine itself, each over whole tables, with DuckDB SQL where SQL can say it."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs, kernels
from ..functions.alphabet import AMINO, REDUCED, codons
from ..operators import compress as C
from ..operators import kmers, links, sets
from ..operators.align import Aligner
from ..sources import compressed_csv, fasta, hits
from ..sources.params import DatabaseParams
from . import search as S
from .scratch import cut, exists, scratch
from .store import Database

K = 6


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as protein sequences."""
    d = _table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seq_id"), F.col("source").alias("name"), exprs.residues_of_text(F.col("text")).alias("residues"))


def bench_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("query_id"), exprs.residues_of_text(F.col("text")).alias("residues"))


#: Folders of databases that this driver has built, by application, tables and what is in them.
_BUILT: dict[tuple, str] = {}


def built(spark: SparkSession, sf_dir: str, what: str, make) -> str:
    """The folder that ``make(path)`` fills, made once an application, as a database is built once and searched often."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _BUILT or not exists(spark, f"{_BUILT[key]}/manifest"):
        path = scratch(spark, what)
        make(path)
        _BUILT[key] = path
    return _BUILT[key]


def documents_db(spark: SparkSession, sf_dir: str) -> Database:
    return Database.open(spark, built(spark, sf_dir, "documents", lambda path: Database.create(spark, path, sequences(spark, sf_dir))))


def compressed_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    db = documents_db(spark, sf_dir)
    return db.compressed, db.coarse


_SEQ = "WITH s AS (SELECT doc_id AS seq_id, source AS name, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'JOU', 'XXX') AS residues FROM documents)"
_HASH = " + ".join(f"(instr('{AMINO}', substr(kmer, {i + 1}, 1)) - 1) * {23 ** (K - 1 - i)}" for i in range(K))
_KMERS = f"{_SEQ}, k AS (SELECT seq_id, r.p AS res_ind, substr(residues, r.p + 1, {K}) AS kmer, residues FROM s, LATERAL (SELECT unnest(range(0, greatest(length(residues) - {K}, 0))) AS p) r)"
_SRC, _DST = "".join(REDUCED.values()), "".join(k * len(v) for k, v in REDUCED.items())


def residue_normalize(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return s.select("seq_id", F.length("residues").cast("long").alias("n"), F.md5("residues").alias("digest"), exprs.repetitive(F.col("residues")).alias("is_repetitive"))


def residue_composition(spark, sf_dir):
    """How often each letter occurs, by its rank."""
    letters = sequences(spark, sf_dir).select(F.explode(F.split("residues", "")).alias("letter")).where("letter <> ''")
    rows = letters.groupBy("letter").agg(F.count("*").alias("n")).select(exprs.amino_digit(F.col("letter")).cast("long").alias("digit"), "n")
    return rows.select("digit", exprs.amino_letter(F.col("digit")).alias("letter"), "n")


def reduce_alphabet(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return s.select("seq_id", F.md5(exprs.reduce_alphabet(F.col("residues"))).alias("digest"))


def reverse_complement(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return s.select("seq_id", F.md5(exprs.reverse_complement(exprs.reduce_alphabet(F.col("residues")))).alias("digest"))


def six_frame_translate(spark, sf_dir):
    s = sequences(spark, sf_dir).select(F.col("seq_id").alias("query_id"), exprs.reduce_alphabet(F.col("residues")).alias("residues"))
    return S.translate_queries(s).select("query_id", F.col("frame").cast("long").alias("frame"), F.length("residues").cast("long").alias("n"), F.md5("residues").alias("digest"))


_CODONS = "{" + ", ".join(f"'{k}': '{'' if v == '_' else v}'" for k, v in codons().items()) + "}"
SIX_SQL = f"""{_SEQ}, n AS (SELECT seq_id, translate(residues, '{_SRC}', '{_DST}') AS f FROM s),
d AS (SELECT seq_id, f, reverse(translate(f, 'ACGTN', 'TGCAN')) AS b FROM n),
r AS (SELECT seq_id, 2 * o AS frame, substr(f, o + 1) AS x FROM d, (VALUES (0), (1), (2)) v(o) UNION ALL SELECT seq_id, 2 * o + 1, substr(b, o + 1) FROM d, (VALUES (0), (1), (2)) v(o)),
p AS (SELECT seq_id, frame, list_aggregate(list_transform(range(0, length(x) // 3), lambda i: CASE WHEN contains(substr(x, (3 * i + 1)::INT, 3), 'N') THEN 'X' ELSE coalesce(MAP {_CODONS}[substr(x, (3 * i + 1)::INT, 3)], '') END), 'string_agg', '') AS protein FROM r)
SELECT seq_id AS query_id, frame::BIGINT AS frame, length(coalesce(protein, ''))::BIGINT AS n, md5(coalesce(protein, '')) AS digest FROM p"""


def kmer_seed_index(spark, sf_dir):
    s = sequences(spark, sf_dir).select(F.col("seq_id").alias("coarse_id"), "residues")
    return kmers.count_seeds(s, K, 0)


def kmer_hash_roundtrip(spark, sf_dir):
    k = kmers.kmers(sequences(spark, sf_dir), "seq_id", "residues", K)
    return k.select("kmer", "kmer_hash", exprs.unhash_kmer(F.col("kmer_hash"), K).alias("back")).distinct()


def low_complexity(spark, sf_dir):
    k = kmers.positions(sequences(spark, sf_dir), "seq_id", "residues", K, pad=3)
    return k.where(exprs.low_complexity_at(F.col("tile"), F.col("at"), 3)).groupBy("seq_id").agg(F.count("*").alias("n_positions"))


def seed_postings(spark, sf_dir):
    s = sequences(spark, sf_dir).select(F.col("seq_id").alias("coarse_id"), "residues")
    per = kmers.seed_lists(kmers.seed_index(s, K, 6))
    return per.groupBy("kmer_hash").agg(F.sum(F.size("locations").cast("long")).alias("n_seeds"))


def pairwise_identity(spark, sf_dir):
    s = sequences(spark, sf_dir)
    pairs = s.select("seq_id", "residues", F.reverse("residues").alias("other"))
    return pairs.select("seq_id", exprs.seq_identity(F.col("residues"), F.col("other")).cast("long").alias("percent"), exprs.same_positions(F.col("residues"), F.col("other")).cast("long").alias("same"))


def db_stats(spark, sf_dir):
    return links.database_stats(sequences(spark, sf_dir)).select("n_sequences", "n_residues", F.col("max_length").cast("long").alias("max_length"))


def compression_ratio(spark, sf_dir):
    _, coarse = compressed_documents(spark, sf_dir)
    return links.compression_ratio(sequences(spark, sf_dir), coarse)


def links_per_fragment(spark, sf_dir):
    """Every fragment has the link of the sequence that it was cut from, at least."""
    compressed, coarse = compressed_documents(spark, sf_dir)
    return links.links_per_coarse(coarse, compressed)


def compress_roundtrip(spark, sf_dir):
    compressed, coarse = compressed_documents(spark, sf_dir)
    return links.decompress(compressed, coarse).select("seq_id", "name", F.length("residues").cast("long").alias("n"), F.md5("residues").alias("digest"))


def compressed_csv_roundtrip(spark, sf_dir):
    compressed, coarse = compressed_documents(spark, sf_dir)
    records = compressed.select("seq_id", compressed_csv.parse_record(compressed_csv.record_of(F.col("name"), F.col("links"))).alias("r"))
    back = links.decompress(records.select("seq_id", "r.name", "r.links"), coarse)
    return back.select("seq_id", "name", F.md5("residues").alias("digest"))


def seed_join_candidates(spark, sf_dir):
    s = sequences(spark, sf_dir).select(F.col("seq_id").alias("coarse_id"), "residues")
    found = kmers.seed_candidates(bench_queries(spark, sf_dir), None, s, K, ext=10)
    return found.groupBy("query_id", "coarse_id").agg(F.count("*").alias("n_seeds"), F.min("q_ind").cast("long").alias("first_q"), F.min("res_ind").cast("long").alias("first_s"))


SEED_JOIN_SQL = f"""{_SEQ}, q AS (SELECT item_id::VARCHAR AS query_id, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'JOU', 'XXX') AS residues FROM benchmark),
a AS (SELECT query_id, r.p AS q_ind, substr(residues, r.p + 1, 16) AS m FROM q, LATERAL (SELECT unnest(range(0, greatest(length(residues) - 15, 0))) AS p) r),
b AS (SELECT seq_id AS coarse_id, r.p AS res_ind, substr(residues, r.p + 1, 16) AS m FROM s, LATERAL (SELECT unnest(range(0, greatest(length(residues) - 16, 0))) AS p) r)
SELECT query_id, coarse_id, count(*) AS n_seeds, min(q_ind)::BIGINT AS first_q, min(res_ind)::BIGINT AS first_s FROM a JOIN b USING (m) GROUP BY ALL"""


def _order_hits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Intervals with many-to-many overlaps by key: lineitem as hits, orders' parts as links."""
    li = _table(spark, sf_dir, "lineitem")
    h = li.select(F.col("l_orderkey").cast("string").alias("query_id"), F.col("l_partkey").alias("coarse_id"), (F.col("l_quantity") * 3).cast("int").alias("hit_start"), (F.col("l_quantity") * 3 - F.col("l_linenumber") * 5).cast("int").alias("hit_end"), (F.col("l_discount") * 100).alias("evalue"))
    k = li.select(F.col("l_partkey").alias("coarse_id"), F.col("l_suppkey").alias("org_seq_id"), F.col("l_quantity").cast("int").alias("c_start"), (F.col("l_quantity") + 20).cast("int").alias("c_end"))
    return h, k


_HITS_SQL = """WITH h AS (SELECT l_orderkey::VARCHAR AS query_id, l_partkey AS coarse_id, (l_quantity * 3)::INT AS a, (l_quantity * 3 - l_linenumber * 5)::INT AS b, l_discount * 100 AS evalue FROM lineitem),
k AS (SELECT l_partkey AS coarse_id, l_suppkey AS org_seq_id, l_quantity::INT AS c_start, (l_quantity + 20)::INT AS c_end FROM lineitem),
x AS (SELECT query_id, org_seq_id, coarse_id, evalue FROM h JOIN k USING (coarse_id) WHERE evalue <= 5.0 AND NOT (greatest(a, b) < c_start OR least(a, b) > c_end))"""


def interval_expand(spark, sf_dir):
    h, k = _order_hits(spark, sf_dir)
    return links.expand_hits(h, k).groupBy("coarse_id").agg(F.count("*").alias("n"), F.countDistinct("org_seq_id").alias("n_originals"), F.countDistinct("query_id").alias("n_queries"))


def expanded_distinct(spark, sf_dir):
    h, k = _order_hits(spark, sf_dir)
    return links.distinct_originals(links.expand_hits(h, k)).select("org_seq_id", F.round("evalue", 6).alias("evalue"))


def two_sided_expand(spark, sf_dir):
    h, k = _order_hits(spark, sf_dir)
    h = h.withColumn("query_id", F.col("coarse_id").cast("string")).withColumn("q_start", F.col("hit_start")).withColumn("q_end", F.col("hit_end"))
    a, b = links.expand_both(h, k, k)
    return a.withColumn("side", F.lit("target")).unionByName(b.withColumn("side", F.lit("query"))).select("side", "org_seq_id", F.round("evalue", 6).alias("evalue"))


def expand_whole(spark, sf_dir):
    h, k = _order_hits(spark, sf_dir)
    return links.expand_whole(h.where(F.col("evalue") < 0.5), k)


def render_links(spark, sf_dir):
    _, k = _order_hits(spark, sf_dir)
    return k.groupBy(exprs.render_inverse_link(F.col("org_seq_id"), F.col("c_start"), F.col("c_end")).alias("link")).agg(F.count("*").alias("n"))


def first_match(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return links.first_match(li, "l_orderkey", ["l_partkey", "l_suppkey", "l_linenumber"])


def top_band_hits(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("subject_id"), F.col("l_extendedprice").alias("bit_score"))
    return sets.top_band(li, 50)


def edit_script_apply(spark, sf_dir):
    """Scripts between each sequence and a mutated copy (a short one only gets letters at its end), built by the kernel,
    parsed, rendered and applied by Spark."""
    rows = sequences(spark, sf_dir)
    long = F.length("residues") > 10
    target = F.concat(F.substring("residues", 1, 3), F.lit("W"), F.substring("residues", 6, 2**31 - 1), F.lit("ACD"))
    end = F.concat("residues", F.lit("ACD"))
    edited = F.concat(F.substring("residues", 1, 3), F.lit("W-"), F.substring("residues", 6, 2**31 - 1), F.lit("ACD"))
    rows = rows.select("seq_id", "residues", F.when(long, target).otherwise(end).alias("target"), F.concat("residues", F.lit("---")).alias("a"), F.when(long, edited).otherwise(end).alias("b"))

    def run(batches):
        import pyarrow as pa

        for t in batches:
            d = [kernels.script_of(a.encode(), b.encode()) for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist())]
            yield pa.RecordBatch.from_arrays([t.column("seq_id"), t.column("residues"), t.column("target"), pa.array(d, pa.string())], names=["seq_id", "residues", "target", "diff"])

    rows = rows.mapInArrow(run, "seq_id long, residues string, target string, diff string")
    return rows.select("seq_id", F.md5(exprs.apply_script(F.col("residues"), F.col("diff"))).alias("digest"), (exprs.render_script(exprs.parse_script(F.col("diff"))) == F.col("diff")).alias("canonical"))


def gapped_lengths(spark, sf_dir):
    s = sequences(spark, sf_dir).select("seq_id", F.regexp_replace("residues", "E", "-").alias("aligned"))
    return s.select("seq_id", exprs.gapped_length(F.col("aligned")).cast("long").alias("n"))


def align_windows(spark, sf_dir):
    """Global alignment of each 25 residues with the next 25, over whole sequences: pairs of windows, their aligned
    letters and the sum of their identities."""
    def run(batches):
        import pyarrow as pa

        for t in batches:
            out = []
            for r in t.column("residues").to_pylist():
                x = r.encode()
                pairs = [kernels.align_global(x[a : a + 25], x[a + 25 : a + 50]) for a in range(0, len(x) - 25, 50)]
                out.append((len(pairs), sum(len(p) for p, _ in pairs), sum(kernels.identity(p, q) for p, q in pairs)))
            yield pa.RecordBatch.from_arrays([t.column("seq_id"), *(pa.array([o[k] for o in out], pa.int64()) for k in range(3))], names=["seq_id", "n_pairs", "aligned", "identity"])

    rows = sequences(spark, sf_dir).select("seq_id", "residues")
    return rows.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "seq_id long, n_pairs long, aligned long, identity long")


def database_size(spark, sf_dir) -> int:
    return documents_db(spark, sf_dir).params.db_size


def two_stage_search(spark, sf_dir):
    compressed, coarse = compressed_documents(spark, sf_dir)
    return S.search(bench_queries(spark, sf_dir), compressed, coarse, database_size(spark, sf_dir), _SEARCH)


#: Seeds of six letters pair nearly all prose with all other prose; README has figures.
_SEARCH = S.Search(aligner=Aligner(seed=12, min_seeds=2))


def one_stage_search(spark, sf_dir):
    """Needs no database, only its size: the residues of all documents."""
    own = sequences(spark, sf_dir)
    size = int(own.agg(F.coalesce(F.sum(F.length("residues").cast("long")), F.lit(0))).first()[0])
    return S.search_one_stage(bench_queries(spark, sf_dir), own, size, _SEARCH)


def iterated_search(spark, sf_dir):
    """The fine stage a second time, with profiles from the hits of the first."""
    compressed, coarse = compressed_documents(spark, sf_dir)
    return S.search_iterated(bench_queries(spark, sf_dir), compressed, coarse, database_size(spark, sf_dir), 2, _SEARCH)


def accuracy_summary(spark, sf_dir):
    return sets.accuracy(one_stage_search(spark, sf_dir), two_stage_search(spark, sf_dir))


def accuracy_sensitive(spark, sf_dir):
    """The same with seeds of eight letters, which hits of large e-values need."""
    s = replace(_SEARCH, aligner=Aligner(seed=8))
    compressed, coarse = compressed_documents(spark, sf_dir)
    size, q = database_size(spark, sf_dir), bench_queries(spark, sf_dir)
    return sets.accuracy(S.search_one_stage(q, sequences(spark, sf_dir), size, s), S.search(q, compressed, coarse, size, s))


def translated_search(spark, sf_dir):
    """Reduced benchmark items as nucleotides, in all six frames, through both stages against a database of proteins
    (those of reduced documents)."""
    def make(path):
        proteins = sequences(spark, sf_dir).select("seq_id", "name", exprs.six_frames(exprs.reduce_alphabet(F.col("residues"))).alias("frames"))
        Database.create(spark, path, proteins.select("seq_id", "name", F.col("frames")[0].alias("residues")))

    db = Database.open(spark, built(spark, sf_dir, "proteins", make))
    q = bench_queries(spark, sf_dir).select("query_id", exprs.reduce_alphabet(F.col("residues")).alias("residues"))
    return S.search_translated(q, db.compressed, db.coarse, db.params.db_size, replace(_SEARCH, aligner=Aligner(seed=8, min_seeds=4)))


def compress_exact(spark, sf_dir):
    """The exact greedy algorithm with its default parameters, in one sequence of steps over all benchmark items, and
    the items restored from its links."""
    b = _table(spark, sf_dir, "benchmark")
    rows = b.select(F.col("item_id").alias("seq_id"), F.col("item_id").cast("string").alias("name"), exprs.residues_of_text(F.col("text")).alias("residues"))
    p = C.Params()
    compressed, coarse = C.number_fragments(cut(C.compress_buckets(C.assign_buckets(rows, p, 1), p), "exact"))
    return links.decompress(compressed, coarse).select("seq_id", "name", F.length("residues").cast("long").alias("n"), F.md5("residues").alias("digest"))


def compress_reduced(spark, sf_dir):
    """Documents in the reduced alphabet, compressed in buckets and restored."""
    p = replace(C.FAST, step=C.REDUCED.step, wildcard=C.REDUCED.wildcard)
    raw = C.compress_reduced(sequences(spark, sf_dir), p)
    compressed, coarse = (cut(t, "reduced") for t in raw)
    return links.decompress(compressed, coarse).select("seq_id", "name", F.length("residues").cast("long").alias("n"), F.md5("residues").alias("digest"))


def append_compress(spark, sf_dir):
    """A database of the documents, to which the benchmark items are appended; all of it read back."""
    def make(path):
        db = Database.create(spark, path, sequences(spark, sf_dir), DatabaseParams(read_only=False))
        b = _table(spark, sf_dir, "benchmark")
        db.append(b.select(F.col("item_id").alias("seq_id"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), exprs.residues_of_text(F.col("text")).alias("residues")))
        db.compact()

    db = Database.open(spark, built(spark, sf_dir, "appended", make))
    return db.sequences().select("seq_id", "name", F.length("residues").cast("long").alias("n"), F.md5("residues").alias("digest"))


def database_lookup(spark, sf_dir):
    """Every hundredth document by its id, from links and fragments alone."""
    ids = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id")).where("seq_id % 100 = 0")
    return documents_db(spark, sf_dir).lookup(ids).select("seq_id", "name", F.md5("residues").alias("digest"))


def sample_records(spark, sf_dir):
    return sets.sample_records(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 100, "o_orderkey")


def append_union(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark")
    new = b.select(F.col("item_id").alias("seq_id"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), exprs.residues_of_text(F.col("text")).alias("residues"))
    return sets.append_records(sequences(spark, sf_dir), new).select("seq_id", "name", F.length("residues").cast("long").alias("n"))


def dedup_exact(spark, sf_dir):
    s = sequences(spark, sf_dir).select(F.md5("residues").alias("digest"), "seq_id")
    return sets.first_of_each(s, "digest", "seq_id")


def fasta_roundtrip(spark, sf_dir):
    path = scratch(spark, "fasta")
    fasta.write_fasta(sequences(spark, sf_dir), path, asterisk=True)
    return fasta.read_fasta(spark, path).select("seq_id", "name", F.md5("residues").alias("digest"))


def tabular_roundtrip(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    cells = ["l_orderkey", "l_partkey", "l_discount", "l_linenumber", "l_linenumber", "l_linenumber", "l_suppkey", "l_suppkey", "l_linenumber", "l_linenumber", "l_tax", "l_extendedprice"]
    text = li.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in cells)).alias("value"))
    h = hits.parse_tabular(text)
    return h.groupBy("query_id").agg(F.count("*").alias("n"), F.min("s_start").cast("long").alias("first_line"), F.max("q_end").cast("long").alias("last_supp"), F.round(F.sum("bit_score"), 2).alias("score"))


def xml_roundtrip(spark, sf_dir):
    li = _table(spark, sf_dir, "orders")
    text = F.format_string("<BlastOutput><BlastOutput_iterations><Iteration><Iteration_query-def>%s</Iteration_query-def><Iteration_hits><Hit><Hit_num>1</Hit_num><Hit_accession>%s</Hit_accession><Hit_hsps><Hsp><Hsp_num>1</Hsp_num><Hsp_evalue>0.5</Hsp_evalue><Hsp_query-from>1</Hsp_query-from><Hsp_query-to>9</Hsp_query-to><Hsp_hit-from>%s</Hsp_hit-from><Hsp_hit-to>20</Hsp_hit-to></Hsp></Hit_hsps></Hit></Iteration_hits></Iteration></BlastOutput_iterations></BlastOutput>", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.pmod("o_custkey", F.lit(7)).cast("string"))
    return hits.parse_xml(li.select(text.alias("x")), "x").select("query_id", "accession", F.col("hit_start").cast("long").alias("hit_start"), "evalue")


def params_roundtrip(spark, sf_dir):
    return DatabaseParams.parse(DatabaseParams.from_table(DatabaseParams(db_size=123).table(spark)).text()).table(spark)


_P = ", ".join(f"('{k}', '{int(v) if isinstance(v, bool) else v}')" for k, v in DatabaseParams(db_size=123).items())

QUERIES = {f.__name__: f for f in (
    residue_normalize, residue_composition, reduce_alphabet, reverse_complement, six_frame_translate, kmer_seed_index, kmer_hash_roundtrip, low_complexity, seed_postings, pairwise_identity, db_stats, compression_ratio, links_per_fragment, compress_roundtrip,
    compressed_csv_roundtrip, seed_join_candidates, interval_expand, expanded_distinct, two_sided_expand, expand_whole, render_links, first_match, top_band_hits, edit_script_apply, gapped_lengths, align_windows, two_stage_search, one_stage_search, iterated_search, accuracy_summary, accuracy_sensitive, translated_search,
    compress_exact, compress_reduced, append_compress, database_lookup,
    sample_records, append_union, dedup_exact, fasta_roundtrip, tabular_roundtrip, xml_roundtrip, params_roundtrip)}

_RUN3 = exprs.run_pattern(3)
_RUN6 = exprs.run_pattern(6)
ORACLES = {
    "residue_normalize": f"{_SEQ} SELECT seq_id, length(residues)::BIGINT AS n, md5(residues) AS digest, length(residues) > 1 AND residues = repeat(substr(residues, 1, 1), length(residues)) AS is_repetitive FROM s",
    "residue_composition": f"{_SEQ}, l AS (SELECT unnest(string_split(residues, '')) AS letter FROM s) SELECT (instr('{AMINO}', letter) - 1)::BIGINT AS digit, letter, count(*) AS n FROM l WHERE letter <> '' GROUP BY ALL",
    "reduce_alphabet": f"{_SEQ} SELECT seq_id, md5(translate(residues, '{_SRC}', '{_DST}')) AS digest FROM s",
    "reverse_complement": f"{_SEQ} SELECT seq_id, md5(reverse(translate(translate(residues, '{_SRC}', '{_DST}'), 'ACGTN', 'TGCAN'))) AS digest FROM s",
    "six_frame_translate": SIX_SQL,
    "kmer_seed_index": f"{_KMERS}, h AS (SELECT seq_id, res_ind, {_HASH} AS kmer_hash FROM k) SELECT kmer_hash::BIGINT AS kmer_hash, count(*) AS n_seeds, min(seq_id) AS first_id, arg_min(res_ind, (seq_id, res_ind))::BIGINT AS first_ind FROM h GROUP BY kmer_hash",
    "kmer_hash_roundtrip": f"{_KMERS} SELECT DISTINCT kmer, ({_HASH})::BIGINT AS kmer_hash, kmer AS back FROM k",
    "low_complexity": f"{_KMERS} SELECT seq_id, count(*) AS n_positions FROM k WHERE regexp_matches(substr(residues, greatest(res_ind - 3, 0)::INT + 1, (least(length(residues), res_ind + 3) - greatest(res_ind - 3, 0))::INT), '{_RUN3}') GROUP BY seq_id",
    "seed_postings": f"{_KMERS}, h AS (SELECT {_HASH} AS kmer_hash FROM k WHERE NOT regexp_matches(substr(residues, greatest(res_ind - 6, 0)::INT + 1, (least(length(residues), res_ind + 6) - greatest(res_ind - 6, 0))::INT), '{_RUN6}')) SELECT kmer_hash::BIGINT AS kmer_hash, count(*) AS n_seeds FROM h GROUP BY kmer_hash",
    "pairwise_identity": f"{_SEQ}, p AS (SELECT seq_id, length(residues) AS n, coalesce(list_sum(list_transform(range(1, length(residues) + 1), lambda i: (substr(residues, i::INT, 1) = substr(residues, (length(residues) + 1 - i)::INT, 1))::INT)), 0) AS same FROM s) SELECT seq_id, CASE WHEN n = 0 THEN 0 ELSE floor(same * 100 / n) END::BIGINT AS percent, same::BIGINT AS same FROM p",
    "db_stats": f"{_SEQ} SELECT count(*) AS n_sequences, sum(length(residues))::BIGINT AS n_residues, max(length(residues))::BIGINT AS max_length FROM s",
    "compress_roundtrip": f"{_SEQ} SELECT seq_id, name, length(residues)::BIGINT AS n, md5(residues) AS digest FROM s",
    "compress_exact": "SELECT item_id AS seq_id, item_id::VARCHAR AS name, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))::BIGINT AS n, md5(translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'JOU', 'XXX')) AS digest FROM benchmark",
    "compress_reduced": f"{_SEQ}, r AS (SELECT seq_id, name, translate(residues, '{_SRC}', '{_DST}') AS x FROM s) SELECT seq_id, name, length(x)::BIGINT AS n, md5(x) AS digest FROM r",
    "append_compress": f"{_SEQ}, a AS (SELECT seq_id, name, residues FROM s UNION ALL SELECT item_id + (SELECT max(doc_id) + 1 FROM documents), 'item' || item_id::VARCHAR, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'JOU', 'XXX') FROM benchmark) SELECT seq_id, name, length(residues)::BIGINT AS n, md5(residues) AS digest FROM a",
    "database_lookup": f"{_SEQ} SELECT seq_id, name, md5(residues) AS digest FROM s WHERE seq_id % 100 = 0",
    "compressed_csv_roundtrip": f"{_SEQ} SELECT seq_id, name, md5(residues) AS digest FROM s",
    "seed_join_candidates": SEED_JOIN_SQL,
    "interval_expand": f"{_HITS_SQL} SELECT coarse_id, count(*) AS n, count(DISTINCT org_seq_id) AS n_originals, count(DISTINCT query_id) AS n_queries FROM x GROUP BY coarse_id",
    "expanded_distinct": f"{_HITS_SQL} SELECT org_seq_id, round(min(evalue), 6) AS evalue FROM x GROUP BY org_seq_id",
    "two_sided_expand": f"{_HITS_SQL}, d AS (SELECT org_seq_id, round(min(evalue), 6) AS evalue FROM x GROUP BY org_seq_id) SELECT 'target' AS side, * FROM d UNION ALL SELECT 'query', * FROM d",
    "expand_whole": f"{_HITS_SQL} SELECT DISTINCT org_seq_id FROM k WHERE coarse_id IN (SELECT coarse_id FROM h WHERE evalue < 0.5)",
    "render_links": f"{_HITS_SQL} SELECT org_seq_id::VARCHAR || ' (' || c_start::VARCHAR || ', ' || c_end::VARCHAR || ')' AS link, count(*) AS n FROM k GROUP BY 1",
    "first_match": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) = 1",
    "top_band_hits": "SELECT l_orderkey AS query_id, l_linenumber AS subject_id, l_extendedprice AS bit_score FROM lineitem QUALIFY l_extendedprice >= 0.5 * max(l_extendedprice) OVER (PARTITION BY l_orderkey)",
    "edit_script_apply": f"{_SEQ} SELECT seq_id, md5(CASE WHEN length(residues) > 10 THEN substr(residues, 1, 3) || 'W' || substr(residues, 6) ELSE residues END || 'ACD') AS digest, true AS canonical FROM s",
    "gapped_lengths": f"{_SEQ} SELECT seq_id, length(replace(residues, 'E', ''))::BIGINT AS n FROM s",
    "sample_records": "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('0:' || o_orderkey::VARCHAR), o_orderkey LIMIT 100",
    "append_union": f"{_SEQ} SELECT seq_id, name, length(residues)::BIGINT AS n FROM s UNION ALL SELECT item_id + (SELECT max(doc_id) + 1 FROM documents), 'item' || item_id::VARCHAR, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))::BIGINT FROM benchmark",
    "dedup_exact": f"{_SEQ} SELECT md5(residues) AS digest, min(seq_id) AS seq_id FROM s GROUP BY 1",
    "fasta_roundtrip": f"{_SEQ} SELECT (row_number() OVER (ORDER BY seq_id) - 1)::BIGINT AS seq_id, name, md5(residues) AS digest FROM s",
    "tabular_roundtrip": "SELECT l_orderkey::VARCHAR AS query_id, count(*) AS n, min(l_linenumber)::BIGINT AS first_line, max(l_suppkey)::BIGINT AS last_supp, round(sum(l_extendedprice), 2) AS score FROM lineitem GROUP BY 1",
    "xml_roundtrip": "SELECT o_orderkey::VARCHAR AS query_id, o_custkey::VARCHAR AS accession, (o_custkey % 7)::BIGINT AS hit_start, 0.5::DOUBLE AS evalue FROM orders",
    "params_roundtrip": f"SELECT * FROM (VALUES {_P}) t(key, value)",
}
