"""The positional queries over the given tables, and the DuckDB SQL for each.

Sequences for pairs and groups are the texts of ``benchmark`` (their ids run from 0), since a result of all pairs has the size of their
square; row-by-row operators take all ``documents``, letters of short texts all of ``part``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lockstep.compare import compare_files
from lockstep.functions.text import interval
from lockstep.operators import diff, layout, positions, sinks
from lockstep.plans import groups
from lockstep.sources import fasta, manifest
from lockstep.sources.files import existing_files, write_texts
from lockstep.sources.shared import fresh_path, written
from lockstep.streaming import incremental

MAX_S = 3
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def benchmark_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta.sequences_from_table(table(spark, sf_dir, "benchmark"), "item_id", "text", "item")


def _count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.sequence_count(benchmark_sequences(spark, sf_dir))


def _manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest line for each document; some languages' lines lack the blank, one source's files do not exist."""
    docs = table(spark, sf_dir, "documents")
    between = F.when(F.col("lang") == "de", ",").otherwise(", ")
    end = F.when(F.col("lang") == "es", F.col("n_chars").cast("string")).otherwise("L-1")
    return docs.select(F.col("doc_id").alias("seq_index"), F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".fasta"), between, F.lit("["), F.col("doc_id").cast("string"), F.lit(","), end, F.lit("]")).alias("line"))


_SQL_LINES = """lines as (select doc_id seq_index, source || '/doc' || doc_id || '.fasta' || case when lang = 'de' then ',' else ', ' end
  || '[' || doc_id || ',' || case when lang = 'es' then n_chars::varchar else 'L-1' end || ']' line from documents)"""
_SQL_PARSED = _SQL_LINES + """, parsed as (select seq_index, split_part(line, ', ', 1) path, regexp_extract(split_part(line, ', ', 2), '\\[(.*),', 1) start_pos,
  regexp_extract(split_part(line, ', ', 2), ',(.*)\\]', 1) end_pos from lines where len(string_split(line, ', ')) = 2)"""


def manifest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.parse_manifest(_manifest_lines(spark, sf_dir))


def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").filter("source <> 'src3'").select(F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".fasta")).alias("path"))
    return manifest.manifest_violations(_manifest_lines(spark, sf_dir), files)


def sequence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.sequence_count(fasta.sequences_from_table(table(spark, sf_dir, "documents"), "doc_id", "text"))


def fasta_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    head = F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.concat(F.lit(">doc "), F.col("doc_id").cast("string"), F.lit(" |"), F.col("lang"), F.lit("\n")))
    return fasta.parse_fasta(docs.select(F.col("doc_id").alias("seq_index"), F.concat(head, F.col("text")).alias("text")))


def select_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("seq_index"))
    return fasta.select_sequences(fasta.sequences_from_table(table(spark, sf_dir, "documents"), "doc_id", "text", "doc"), chosen)


def sequences_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta.sequences_from_table(table(spark, sf_dir, "documents"), "doc_id", "text", "doc")


def interval_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumns({"start_pos": (F.col("n_chars") % 41 - 20).cast("string"), "end_pos": F.when(F.col("lang") == "en", "L-1").otherwise((F.col("doc_id") % 301 - 100).cast("string"))})
    return docs.select(F.col("doc_id").alias("seq_index"), "start_pos", "end_pos", interval(F.col("text"), F.col("start_pos"), F.col("end_pos")).alias("seq"))


def _members(spark: SparkSession, sf_dir: str, max_s: int | None = MAX_S) -> DataFrame:
    return positions.members_of(groups.exploded(groups.chunk_plan(_count(spark, sf_dir), max_s)), benchmark_sequences(spark, sf_dir))


def sequence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that begin with T stand for headerless sequences."""
    headed = _members(spark, sf_dir).withColumn("seq_id", F.when(F.col("seq").startswith("T"), "Seq").otherwise(F.col("seq_id")))
    return positions.label_members(headed).select("first_index", "chunk", "side", "ordinal", "seq_index", "label")


def positional_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.explode_positions(fasta.sequences_from_table(table(spark, sf_dir, "part"), "p_partkey", "p_name"))


def null_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.pad_positions(_members(spark, sf_dir), ["first_index", "chunk"]).select("first_index", "chunk", "side", "ordinal", "Index", "letter")


def longest_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.longest_sequence(_members(spark, sf_dir), ["first_index", "chunk"])


def union_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, letters = groups.exploded(groups.chunk_plan(_count(spark, sf_dir), MAX_S)), positions.explode_positions(benchmark_sequences(spark, sf_dir))
    first = plan.select("first_index", "chunk", F.lit(0).alias("side"), F.col("first_index").alias("seq_index")).distinct()
    second = plan.select("first_index", "chunk", F.lit(1).alias("side"), F.col("second_index").alias("seq_index"))
    return positions.union_sides(first, second).join(letters, "seq_index")


def pair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.pair_plan(_count(spark, sf_dir))


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.chunk_plan(_count(spark, sf_dir), MAX_S).select("first_index", "chunk", F.array_join(F.transform("second_indices", lambda x: x.cast("string")), ",").alias("second_indices"))


def plan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.plan_statistics(_count(spark, sf_dir), [1, 2, 3, 7, 30, 1000])


def _pairs(strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: diff.diff_pairs(benchmark_sequences(spark, sf_dir), strategy)


def diff_pairs_outer_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_pairs_outer_form(benchmark_sequences(spark, sf_dir))


def diff_pairs_of_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only pairs of neighbours in the manifest's order."""
    plan = groups.pair_plan(_count(spark, sf_dir)).filter("second_index = first_index + 1")
    return diff.diff_pairs(benchmark_sequences(spark, sf_dir), "block", plan)


def _letters(df: DataFrame) -> DataFrame:
    """Arrays as text, with ``-`` for a missing letter, so that both engines compare like with like."""
    return df.withColumn("letters", F.array_join("letters", "", "-"))


def diff_one_vs_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(diff.one_vs_many(benchmark_sequences(spark, sf_dir), MAX_S))


def diff_one_vs_many_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(diff.one_vs_many(benchmark_sequences(spark, sf_dir), MAX_S, layout="compact"))


def diff_one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(diff.one_vs_many(benchmark_sequences(spark, sf_dir)))


def keep_differing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(diff.one_vs_many(benchmark_sequences(spark, sf_dir), MAX_S, sign=False))


def equal_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(diff.substitute_equal(diff.one_vs_many(benchmark_sequences(spark, sf_dir), MAX_S, sign=False)))


def diff_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(diff.diff_by_group(benchmark_sequences(spark, sf_dir), MAX_S))


def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.with_zeros(diff.count_differences(benchmark_sequences(spark, sf_dir)), pair_plan(spark, sf_dir))


def diff_counts_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_counts(diff.diff_pairs(benchmark_sequences(spark, sf_dir)), pair_plan(spark, sf_dir))


def diff_counts_of_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only pairs of neighbours in the manifest's order."""
    plan = groups.pair_plan(_count(spark, sf_dir)).filter("second_index = first_index + 1")
    return diff.with_zeros(diff.count_differences(benchmark_sequences(spark, sf_dir), plan), plan)


def row_text_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.as_lines(diff.one_vs_many(benchmark_sequences(spark, sf_dir), MAX_S))


def wide_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column a region: the letters are the first ones of its customers' market segments, in order of key."""
    nations = F.broadcast(table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    customers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    rank = F.row_number().over(Window.partitionBy("r_regionkey").orderBy("c_custkey")).cast("long") - 1
    letters = customers.select(F.col("r_regionkey").alias("seq_index"), F.concat(F.lit("Seq_"), "r_name").alias("label"), rank.alias("Index"), F.substring("c_mktsegment", 1, 1).alias("letter"))
    return layout.wide(letters, [f"Seq_{r}" for r in REGIONS])


def wide_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups as one wide table, a column for each place of a chunk."""
    return layout.wide_groups(diff.one_vs_many(benchmark_sequences(spark, sf_dir), MAX_S), MAX_S)


def sorted_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.in_order(diff.diff_pairs(benchmark_sequences(spark, sf_dir)))


def destination_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.named_groups(groups.chunk_plan(_count(spark, sf_dir), MAX_S))


def sink_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder a group, all written by one job."""
    found = sinks.flat(diff.one_vs_many(benchmark_sequences(spark, sf_dir)))
    path, names = fresh_path(spark, "distributed"), layout.named_groups(groups.chunk_plan(_count(spark, sf_dir)))
    sinks.write_distributed(found.join(names, ["first_index", "chunk"]).repartition("group_name"), path, by="group_name")
    return sinks.read_csv(spark, path, "first_index long, chunk long, Index long, first_letter string, letters string, group_name string")


def sink_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, path = diff.diff_pairs(benchmark_sequences(spark, sf_dir)), fresh_path(spark, "merged")
    sinks.write_merged(pairs, path)
    return sinks.read_csv(spark, path, pairs.schema)


def sink_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.collect_phase(diff.diff_pairs(benchmark_sequences(spark, sf_dir)), "None")


def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts arrive and are compared with the suppliers' names."""
    schema = table(spark, sf_dir, "benchmark").schema
    arriving = fasta.sequences_from_table(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir)), "item_id", "text")
    known = fasta.sequences_from_table(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name")
    return incremental.write_differences(arriving, known, fresh_path(spark, "arrived"), fresh_path(spark, "progress"))


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """The benchmark texts in a folder, as a stream reads only folders."""
    path = fresh_path(spark, "arriving")
    table(spark, sf_dir, "benchmark").write.parquet(path)
    return path


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """A FASTA file for each document, in a folder whose name has a blank, a plus and a percent sign; ``seq_index, path`` and the folder."""
    folder = fresh_path(spark, "fasta") + "/a b+c%25"
    docs = table(spark, sf_dir, "documents")
    head = F.concat(F.lit(">doc "), F.col("doc_id").cast("string"), F.lit(" |"), F.col("lang"), F.lit("\n"))
    texts = docs.select(F.col("doc_id").cast("long").alias("seq_index"), F.concat(head, F.coalesce("text", F.lit(""))).alias("value"))
    if folder.startswith("file:"):
        return write_texts(texts.select("seq_index", F.concat("value", F.lit("\n")).alias("text")), folder), folder
    texts.withColumnRenamed("seq_index", "doc_id").write.partitionBy("doc_id").text(folder)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return written(listed.select(F.regexp_extract("path", "/doc_id=([0-9]+)/", 1).cast("long").alias("seq_index"), F.concat(F.lit(folder), F.regexp_extract("path", "/doc_id=.*$", 0)).alias("path")), "listed"), folder


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of a manifest of real files: every tenth path is wrong."""
    files, _ = _files(spark, sf_dir)
    path = F.concat("path", F.when(F.col("seq_index") % 10 == 0, ".gone").otherwise(""))
    lines = files.select("seq_index", F.concat(path, F.lit(", [0,L-1]")).alias("line"))
    return manifest.manifest_violations(lines, existing_files(spark, manifest.parse_manifest(lines)))


def fasta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest lines written, read again, checked, and their files read, parsed and cut."""
    files, _ = _files(spark, sf_dir)
    listed = files.select("seq_index", "path", (F.col("seq_index") % 7).cast("string").alias("start_pos"), F.when(F.col("seq_index") % 2 == 0, "L-1").otherwise((F.col("seq_index") % 300).cast("string")).alias("end_pos"))
    return fasta.read_sequences(spark, listed)


def fasta_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files and intervals, read line by line into blocks, as for sequences that are too long for a row."""
    files, _ = _files(spark, sf_dir)
    listed = files.select("seq_index", "path", (F.col("seq_index") % 7).cast("string").alias("start_pos"), F.when(F.col("seq_index") % 2 == 0, "L-1").otherwise((F.col("seq_index") % 300).cast("string")).alias("end_pos"))
    return fasta.read_blocks(spark, listed)


def compare_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a manifest's text to differences in one call: a file for each benchmark text, each against chunks of the later ones."""
    folder = fresh_path(spark, "compared")
    sequences = benchmark_sequences(spark, sf_dir).withColumn("seq", F.translate("seq", "\n", "/"))
    sequences.select("seq_index", F.concat(F.lit(">"), "seq_id", F.lit(" |x\n"), "seq").alias("value")).write.partitionBy("seq_index").text(f"{folder}/files")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/files").select("path")
    lines = listed.select(F.regexp_extract("path", "/seq_index=([0-9]+)/", 1).cast("long").alias("k"), F.concat(F.lit(f"{folder}/files"), F.regexp_extract("path", "/seq_index=.*$", 0), F.lit(", [0,L-1]")).alias("line"))
    lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("value")).write.text(f"{folder}/list")  # a line a file
    return _letters(compare_files(spark, f"{folder}/list", "None", max_s=MAX_S))


def sink_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups in at most eight files, with an index."""
    found = sinks.flat(diff.one_vs_many(benchmark_sequences(spark, sf_dir)))
    path, names = fresh_path(spark, "bucketed"), layout.named_groups(groups.chunk_plan(_count(spark, sf_dir)))
    sinks.write_bucketed(found.join(names, ["first_index", "chunk"]), path, files=8)
    return sinks.read_bucketed(spark, path, "first_index long, chunk long, Index long, first_letter string, letters string, group_name string")


def incremental_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts arrive in several batches and meet the suppliers' names (numbered below zero) and each other."""
    folder = fresh_path(spark, "arriving")
    texts = table(spark, sf_dir, "benchmark")
    texts.repartition(6).write.parquet(folder)
    arriving = fasta.sequences_from_table(spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 2).parquet(folder), "item_id", "text")
    known = fasta.sequences_from_table(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name").withColumn("seq_index", -1 - F.col("seq_index"))
    return incremental.compare_arrivals(arriving, known, fresh_path(spark, "index"), fresh_path(spark, "found"), fresh_path(spark, "progress"))


def sink_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder a group of text lines under a header."""
    plan, path = groups.chunk_plan(_count(spark, sf_dir), MAX_S), fresh_path(spark, "lines")
    headers = layout.header_lines(positions.label_members(_members(spark, sf_dir)), plan)
    one_line = benchmark_sequences(spark, sf_dir).withColumn("seq", F.translate("seq", "\n", "/"))  # a line end as a letter would end a line of the file
    sinks.write_lines(layout.as_lines(diff.one_vs_many(one_line, MAX_S)), path, headers)
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), F.col("group_name").cast("string"))


_SEQ = "s as (select item_id i, text q from benchmark), p as (select i, unnest(range(length(q))) \"Index\", unnest(string_split(q, '')) c from s where q <> '')"
_N = "n as (select count(*) n from benchmark)"
_CHUNKS = f"{_N}, e as (select a.item_id first_index, (b.item_id - a.item_id - 1) // {MAX_S} chunk, b.item_id second_index, (b.item_id - a.item_id - 1) % {MAX_S} ordinal from benchmark a join benchmark b on a.item_id < b.item_id)"
_PAIRS = f'with {_SEQ} select a.i first_index, b.i second_index, a."Index", a.c first_letter, b.c second_letter from p a join p b on a."Index" = b."Index" and a.i < b.i and a.c <> b.c'


def _groups_sql(letter: str, chunks: str = _CHUNKS, tail: str = "select * from g") -> str:
    return f"""with {_SEQ}, {chunks}, j as (select e.first_index, e.chunk, e.ordinal, a."Index", a.c first_letter, b.c from e join p a on a.i = e.first_index left join p b on b.i = e.second_index and b."Index" = a."Index"),
      g as (select first_index, chunk, "Index", first_letter, string_agg({letter}, '' order by ordinal) letters from j group by all having bool_or(c <> first_letter)) {tail}"""


_CANONICAL = "case when c is null then '-' when c = first_letter then '=' else c end"
_COMPACT = "case when c is null then '' when c = first_letter then '=' else c end"
_MEMBERS = f"{_CHUNKS}, m as (select distinct first_index, chunk, 0 side, 0::bigint ordinal, first_index seq_index from e union all select first_index, chunk, 1, ordinal, second_index from e), ms as (select m.*, text q from m join benchmark on item_id = seq_index)"
_REST = "e as (select a.item_id first_index, 0::bigint chunk, b.item_id second_index, b.item_id - a.item_id - 1 ordinal from benchmark a join benchmark b on a.item_id < b.item_id)"
_NAMES = """case when max(second_index) = min(second_index) then 'sequence_' || first_index || '_diff_sequence_' || min(second_index)
  else 'sequence_' || first_index || '_diff_sequences_' || min(second_index) || '_to_' || max(second_index) end"""
_SUPPLIERS = "t as (select s_suppkey i, unnest(range(length(s_name))) \"Index\", unnest(string_split(s_name, '')) c from supplier)"
_LINES = f"""{_SEQ}, {_CHUNKS}, j as (select e.first_index, e.chunk, e.ordinal, a."Index", a.c first_letter, b.c from e join p a on a.i = e.first_index left join p b on b.i = e.second_index and b."Index" = a."Index"),
      w as (select first_index, chunk, "Index", translate("Index" || ',' || first_letter || ',' || string_agg(case when c = first_letter then '=' else c end, ',' order by ordinal), ''' ()[]', '') line
      from j group by first_index, chunk, "Index", first_letter having bool_or(c <> first_letter))"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        manifest_parse, manifest_violations, sequence_count, fasta_parse, select_sequences, sequences_from_table, interval_slice, sequence_labels, positional_explode, null_padding, equal_substitution,
        keep_differing_rows, wide_layout, wide_groups, row_text_format, pair_plan, chunk_plan, plan_statistics, diff_one_vs_many, diff_one_vs_many_compact, diff_one_vs_rest, diff_pairs_outer_form, diff_pairs_of_plan, union_sides, diff_by_group,
        longest_sequence, diff_counts, diff_counts_of_rows, diff_counts_of_plan, sorted_diff, sink_distributed, sink_merged, sink_none, sink_lines, destination_names, incremental_diff, manifest_files, fasta_files, fasta_blocks, compare_manifest, sink_bucketed, incremental_pairs,
    )
} | {"diff_pairs": _pairs("allele")} | {f"diff_pairs_{s}": _pairs(s) for s in ("join", "group", "block", "consensus")}

ORACLE_SQL: dict[str, str] = {
    "manifest_parse": f"with {_SQL_PARSED} select * from parsed",
    "manifest_violations": f"""with {_SQL_PARSED}, files as (select source || '/doc' || doc_id || '.fasta' path from documents where source <> 'src3')
      select seq_index, 'bad field count' violation from lines where len(string_split(line, ', ')) <> 2
      union all select seq_index, 'file not found' from parsed where path not in (select path from files)
      union all select null, 'fewer than 2 sequences' from (select count(*) n from lines) where n < 2""",
    "sequence_count": "select count(*) n_sequences from documents",
    "fasta_parse": r"""with t as (select doc_id, lang, case when lang = 'fr' then text else '>doc ' || doc_id || ' |' || lang || chr(10) || text end x from documents),
      l as (select *, string_split(regexp_replace(x, '\r\n?', chr(10), 'g'), chr(10)) ls from t)
      select doc_id seq_index, case when ls[1][1] = '>' then replace(replace(split_part(ls[1], '|', 1), '>', ''), ' ', '') else 'Seq' end seq_id,
      array_to_string(list_transform(ls[2:], lambda y: regexp_replace(y, '\s+$', '')), '') seq from l""",
    "select_sequences": "select doc_id seq_index, 'doc' || doc_id seq_id, text seq from documents where doc_id in (select doc_id from labels where quality = 1)",
    "sequences_from_table": "select doc_id seq_index, 'doc' || doc_id seq_id, coalesce(text, '') seq from documents",
    "interval_slice": """with t as (select doc_id, text, length(text) n, n_chars % 41 - 20 s, case when lang = 'en' then null else doc_id % 301 - 100 end e from documents),
      u as (select *, case when s < 0 then greatest(n + s, 0) else least(s, n) end a, case when e is null then n when e < 0 then greatest(n + e, 0) else least(e, n) end b from t)
      select doc_id seq_index, s::varchar start_pos, coalesce(e::varchar, 'L-1') end_pos, substring(text, a + 1, greatest(b - a, 0)) seq from u""",
    "sequence_labels": f"with {_MEMBERS} select first_index, chunk, side, ordinal, seq_index, case when q like 'T%' then 'Seq_' || (ordinal + 1) else 'Seq_item' || seq_index end \"label\" from ms",
    "positional_explode": "select p_partkey seq_index, unnest(range(length(p_name))) \"Index\", unnest(string_split(p_name, '')) letter from part where p_name <> ''",
    "null_padding": f"""with {_MEMBERS}, w as (select first_index, chunk, max(length(q)) longest from ms group by all)
      select first_index, chunk, side, ordinal, k "Index", case when k < length(q) then string_split(q, '')[k + 1] end letter from (select *, unnest(range(longest)) k from ms join w using (first_index, chunk))""",
    "equal_substitution": _groups_sql(_CANONICAL),
    "keep_differing_rows": _groups_sql("coalesce(c, '-')"),
    "wide_layout": "with t as (select r_name, row_number() over (partition by r_regionkey order by c_custkey) - 1 \"Index\", c_mktsegment[1] c from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey) select \"Index\", "
    + ", ".join(f"max(c) filter (r_name = '{r}') \"Seq_{r}\"" for r in REGIONS) + " from t group by 1",
    "wide_groups": f"""with {_SEQ}, {_CHUNKS}, j as (select e.first_index, e.chunk, e.ordinal, a."Index", a.c fl, b.c from e join p a on a.i = e.first_index left join p b on b.i = e.second_index and b."Index" = a."Index")
      select first_index, chunk, "Index", fl "first", {", ".join(f"max(case when c = fl then '=' else c end) filter (ordinal = {k}) second_{k}" for k in range(MAX_S))} from j group by all having bool_or(c <> fl)""",
    "row_text_format": f"with {_LINES} select * from w",
    "sink_lines": f"""with {_LINES.replace("text q", "translate(text, chr(10), '/') q")}, g as (select first_index, chunk, {_NAMES} group_name, 'Index,Seq_item' || first_index || ',' || string_agg('Seq_item' || second_index, ',' order by ordinal) line from e group by first_index, chunk)
      select line, group_name from g union all select w.line, group_name from w join g using (first_index, chunk)""",
    "fasta_files": r"""with t as (select doc_id, lang, doc_id % 7 s, doc_id % 300 z, string_split(regexp_replace('>doc ' || doc_id || ' |' || lang || chr(10) || coalesce(text, '') || chr(10), '\r\n?', chr(10), 'g'), chr(10)) ls from documents),
      u as (select *, array_to_string(list_transform(ls[2:], lambda y: regexp_replace(y, '\s+$', '')), '') q from t)
      select doc_id seq_index, 'doc' || doc_id seq_id, case when doc_id % 2 = 0 then substring(q, s + 1) else substring(q, s + 1, greatest(least(z, length(q)) - s, 0)) end seq from u""",
    "fasta_blocks": r"""with t as (select doc_id, lang, doc_id % 7 s, doc_id % 300 z, string_split(regexp_replace('>doc ' || doc_id || ' |' || lang || chr(10) || coalesce(text, '') || chr(10), '\r\n?', chr(10), 'g'), chr(10)) ls from documents),
      u as (select *, array_to_string(list_transform(ls[2:], lambda y: regexp_replace(y, '\s+$', '')), '') q from t),
      v as (select doc_id seq_index, 'doc' || doc_id seq_id, case when doc_id % 2 = 0 then substring(q, s + 1) else substring(q, s + 1, greatest(least(z, length(q)) - s, 0)) end seq from u)
      select seq_index, b::int "block", substring(seq, b * 256 + 1, 256) part from (select *, unnest(range((length(seq) + 255) // 256)) b from v)""",
    "manifest_files": "select doc_id seq_index, 'file not found' violation from documents where doc_id % 10 = 0",
    "pair_plan": "select a.item_id first_index, b.item_id second_index from benchmark a join benchmark b on a.item_id < b.item_id",
    "chunk_plan": f"with {_CHUNKS} select first_index, chunk, string_agg(second_index::varchar, ',' order by ordinal) second_indices from e group by all",
    "plan_statistics": f"""with {_N}, z as (select n, unnest([1, 2, 3, 7, 30, 1000])::bigint m from n),
      t as (select n, m, (case when m = 1 then n * (n - 1) // 2 when m < n / 2 then ceil(n * (n - 1) / m - n * (n - m) / (2 * m)) when m < n then 2 * (n - 1) - m else 0 end)::bigint estimated,
      list_sum(list_transform(range(n - 1), lambda i: ceil((n - 1 - i) / m)))::bigint actual from z)
      select n n_sequences, m max_s, estimated, actual, abs(estimated - actual) absolute_error, case when estimated <> 0 then abs(estimated - actual) * 100.0::double / estimated end percent_error from t""",
    "diff_one_vs_many": _groups_sql(_CANONICAL),
    "diff_one_vs_many_compact": _groups_sql(_COMPACT),
    "diff_one_vs_rest": _groups_sql(_CANONICAL, _REST),
    "diff_pairs_of_plan": _PAIRS + " and b.i = a.i + 1",
    "union_sides": f"with {_SEQ}, {_MEMBERS} select seq_index, first_index, chunk, side, \"Index\", c letter from m join p on p.i = seq_index",
    "diff_by_group": _groups_sql(_CANONICAL),
    "longest_sequence": f"with {_MEMBERS} select first_index, chunk, max(length(q)) longest from ms group by all",
    "diff_counts": f"with d as ({_PAIRS}) select a.item_id first_index, b.item_id second_index, (select count(*) from d where d.first_index = a.item_id and d.second_index = b.item_id) n_diffs from benchmark a join benchmark b on a.item_id < b.item_id",
    "diff_counts_of_rows": f"with d as ({_PAIRS}) select a.item_id first_index, b.item_id second_index, (select count(*) from d where d.first_index = a.item_id and d.second_index = b.item_id) n_diffs from benchmark a join benchmark b on a.item_id < b.item_id",
    "diff_counts_of_plan": f"with d as ({_PAIRS}) select a.item_id first_index, b.item_id second_index, (select count(*) from d where d.first_index = a.item_id and d.second_index = b.item_id) n_diffs from benchmark a join benchmark b on b.item_id = a.item_id + 1",
    "sink_distributed": _groups_sql(
        "case when c is null then '' when c = first_letter then '=' else c end || ','", _REST,
        f"select g.first_index, g.chunk, \"Index\", first_letter, left(letters, length(letters) - 1) letters, group_name from g join (select first_index, chunk, {_NAMES} group_name from e group by first_index, chunk) using (first_index, chunk)",
    ),
    "compare_manifest": _groups_sql(_CANONICAL).replace("text q", "translate(text, chr(10), '/') q"),
    "incremental_pairs": f"{_PAIRS} union all select -1 - t.i, p.i, p.\"Index\", t.c, p.c from p join ({_SUPPLIERS[_SUPPLIERS.index('(') + 1 : -1]}) t on p.\"Index\" = t.\"Index\" and p.c <> t.c",
    "destination_names": f"with {_CHUNKS} select first_index, chunk, {_NAMES} group_name from e group by first_index, chunk",
    "incremental_diff": f'with {_SEQ}, {_SUPPLIERS} select p.i new_index, t.i known_index, p."Index", p.c new_letter, t.c known_letter from p join t on p."Index" = t."Index" and p.c <> t.c',
} | {name: _PAIRS for name in ("diff_pairs", "diff_pairs_join", "diff_pairs_group", "diff_pairs_block", "diff_pairs_consensus", "diff_pairs_outer_form", "sorted_diff", "sink_none", "sink_merged")}
ORACLE_SQL["sink_bucketed"] = ORACLE_SQL["sink_distributed"]
