"""The queries of this subpackage, each over the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm import ball_tree, chat, extraction, filter_audit, fingerprints, line_rules, mixing, neighbours, packing, quality, sharding, simhash, urls

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest(chat.read_back(chat.format_chat(turns, RANKS, VOCABULARY), RANKS)).drop("n_tokens", "loss_tokens")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), RANKS, VOCABULARY)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    return quality.scored(documents, model, keep=["doc_id"]).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    rules = spark.createDataFrame(listed, "verdict string, host string, path string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules.measure(table(spark, sf_dir, "documents"))
    return found.withColumn("cleaned_sha256", F.sha2("cleaned", 256)).drop("cleaned", "lost_lines")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_formatting, op2_best_fit_packing, op3_quality_classifier, op4_nearest_neighbours, op5_html_extraction, op6_sharding, op7_simhash_near_dedup, op8_url_filters, op9_mixing, op10_document_fingerprints, op11_quality_rules, op12_ranked_search, op13_filter_audit)}
_ESCAPED = r"regexp_replace({}, '<(\\*)\|(im_start|im_end|endoftext)\|>', '<\1\\|\2|>', 'g')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REMOVED = "length({0}) - length(translate({0}, '{1}', ''))"
_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_LOWERED.format("text"))
_FITS = "from rules where host <> '' and (host = rh or suffix(host, '.' || rh)) and starts_with(path, rp)"



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(texts: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(_quoted, texts)) + "]"


#: Only where SQL has the means: no other query's hashes, token ids, models or packings exist in DuckDB.
ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": f"""with t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
        union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
      select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, r, x)) turns_sha256,
        coalesce(sum(length(x)) filter (r = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(x, '' order by turn nulls first, r, x) filter (r = 'assistant'), '')) loss_sha256,
        sum(24 + length({_ESCAPED.format("replace(replace(r, '" + chr(92) + "', '" + chr(92) * 2 + "'), chr(10), '" + chr(92) + "n')")}) + length({_ESCAPED.format("x")}))::bigint formatted_chars from t group by conv_id""",
    "op8_url_filters": f"""with rules(verdict, rh, rp) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
      u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end r from pages),
      h as (select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path from u)
      select page_id, host, path, (select arg_max(rh || rp, length(rh || rp)) {_FITS}) "rule", coalesce((select arg_max(verdict, length(rh || rp)) {_FITS}), 'allow') verdict from h""",
    "op11_quality_rules": f"""with d as (select row_number() over () r, doc_id, coalesce(text, '') x from documents), w as (select r, doc_id, x, {_WORDS.format("x")} ws from d),
      each as (select r, unnest(ws) w, generate_subscripts(ws, 1) k from w),
      win as (select r, k, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o v from each window o as (partition by r order by k)),
      many as (select r, k, v is not null and count(*) over (partition by r, v) > 1 twice from win),
      inside as (select r, count(*) filter (twice or coalesce(lag1, false) or coalesce(lag2, false)) n from (select r, twice, lag(twice, 1) over o lag1, lag(twice, 2) over o lag2 from many window o as (partition by r order by k)) group by r),
      ls as (select r, unnest(string_split(x, chr(10))) l, generate_subscripts(string_split(x, chr(10)), 1) k from w),
      lw as (select *, {_WORDS.format("l")} ws, row_number() over (partition by r, l order by k) > 1 again from ls),
      lc as (select *, array_to_string(ws, '') j, {_LOWERED.format("array_to_string(ws, ' ')")} low from lw where len(ws) > 0),
      lj as (select r, k, l, length(j) chars, again, again
          or (len(ws) <= {line_rules.SHORT} and len(list_filter({_listed(line_rules.PHRASES)}, lambda p: contains(low, p))) > 0)
          or (len(list_filter(ws, lambda y: list_contains({_listed(line_rules.SEPARATORS)}, y))) >= 2 and 4 * len(list_filter(ws, lambda y: list_contains({_listed(line_rules.SEPARATORS)}, y))) >= len(ws))
          or 10 * ({_REMOVED.format("j", line_rules.SYMBOLS + line_rules.MORE_SYMBOLS)}) > length(j)
          or (len(ws) >= 3 and {_REMOVED.format("j", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")} > {_REMOVED.format("j", "abcdefghijklmnopqrstuvwxyz")})
          or len(list_filter(case when len(ws) > {line_rules.SHORT} then ws else ws[-1:] end, lambda y: regexp_matches(rtrim(y, {_quoted(line_rules.CLOSING)}), '[{line_rules.ENDS}]$'))) = 0 bad from lc),
      lines as (select r, sum(chars) total, coalesce(sum(chars) filter (bad), 0) lost, count(*) filter (again) dups, string_agg(l, chr(10) order by k) filter (not bad) cleaned from lj group by r),
      t as (select doc_id, len(ws) n_words, coalesce(total, 0) word_chars, {_REMOVED.format("x", line_rules.SYMBOLS)} n_symbols, coalesce(dups, 0) n_dup_lines, coalesce(n, 0) n_repeat_words, coalesce(lost, 0) lost_chars, coalesce(cleaned, '') cleaned
        from w left join lines using (r) left join inside using (r)),
      b as (select *, n_words < {line_rules.LEAST_WORDS} or 100 * n_repeat_words > {line_rules.MOST_REPEATED} * n_words base_failed from t)
      select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * lost_chars <= {line_rules.MOST_LOST} * word_chars kept, lost_chars::bigint lost_chars, sha256(cleaned) cleaned_sha256 from b""",
    "op12_ranked_search": f"""with d as (select row_number() over () r, doc_id, {_TERMS} ts from documents where text is not null), s as (select count(*) n_docs, sum(len(ts))::bigint n_terms from d where len(ts) > 0),
      q as (select distinct item_id, unnest({_TERMS}) t from benchmark where text is not null), tf as (select r, t, count(*) tf from (select r, unnest(ts) t from d) where t in (select t from q) group by r, t),
      w as (select t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint w from tf, s group by t, n_docs),
      x as (select r, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ts) * n_docs) // n_terms))) x from tf join d using (r) join w using (t), s),
      sc as (select item_id, doc_id, sum(x)::bigint score from q join x using (t) join d using (r) group by item_id, r, doc_id having sum(x) > 0)
      select item_id, (row_number() over (partition by item_id order by score desc, doc_id nulls last))::int "rank", doc_id, score from sc qualify "rank" <= 10""",
    "op13_filter_audit": f"""with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') x from documents), first as (select x, min(doc_id) least from d group by x),
      w as (select doc_id, part, x, {_WORDS.format("x")} ws from d), known as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id),
      m as (select part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * ({_REMOVED.format("w.x", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")}) > 10 * length(w.x), regexp_matches(w.x, '[#$%&*|]'), coalesce(w.doc_id > least, false)] fails,
        coalesce(good, 0) good, coalesce(toxic, 0) toxic from w join first using (x) left join known using (doc_id)),
      c as (select part, fails, count(*) n, sum(good) good, sum(toxic) toxic from m group by part, fails),
      letter as (select unnest(range(1, 6)) f), orders as (select [a.f, b.f, c.f, d.f, e.f] o from letter a, letter b, letter c, letter d, letter e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
      steps as (select o, unnest(range(1, 6)) step from orders),
      z as (select part, o, step, fails[o[step]] fails_here, len(list_filter(o[:step - 1], lambda f: fails[f])) > 0 gone, len(list_filter(fails, lambda y: y)) one, n, good, toxic from steps, c),
      g as (select part, o, step, o[step] f, sum(n) filter (not gone and not fails_here) kept, sum(n) filter (fails_here and not gone) removed, sum(n) filter (fails_here and gone) redundant, sum(n) filter (fails_here and one = 1) unique_fails,
        sum(good) filter (fails_here and not gone) good_lost, sum(toxic) filter (fails_here and not gone) toxic_lost from z group by part, o, step)
      select part, array_to_string(list_transform(o, lambda f: substr('ABCDE', f, 1)), '') filter_order, step::int step, {", ".join(f"coalesce({c}, 0)::bigint {c}" for c in filter_audit.COUNTS[:-1])},
        coalesce(sum(removed) over (partition by part, f), 0)::bigint shapley from g""",
}
