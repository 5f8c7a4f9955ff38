"""Queries of the training-data operators and the SQL that their results are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.encode import decode_ids, encode_texts
from lintlake.llm.filekind import file_kinds
from lintlake.llm.mix import mix_shares, token_sizes, weighted_mix
from lintlake.llm.neardup import all_pairs, duplicate_groups, near_duplicates
from lintlake.llm.repetition import perplexities, perplexity_bands, repeated_shares
from lintlake.llm.spans import file_texts, shared_shares, shared_spans
from lintlake.llm.topn import top_n_per_group
from lintlake.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


# Problem 2: long exact spans shared between records

SPAN = 200


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "code_blocks").select(F.lit("block").alias("kind"), F.col("block_id").cast("string").alias("key"), F.col("block_text").alias("text"))
    files = file_texts(table(spark, sf_dir, "line_hashes")).select(F.lit("file").alias("kind"), "key", "text")
    return blocks.unionByName(files)


@_query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = shared_spans(_records(spark, sf_dir), SPAN)
    return matches.select(F.col("kind").alias("record_kind"), F.col("key").alias("record_key")).distinct()


@_query
def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every record is shared with other records of its kind."""
    records = _records(spark, sf_dir)
    shares = shared_shares(records, shared_spans(records, SPAN))
    return shares.select(F.col("kind").alias("record_kind"), F.col("key").alias("record_key"), "n_characters", "n_shared", F.round("shared_share", 6).alias("shared_share"))


_WINDOWS = """with lines as (select distinct file_path, unnest(line_nos) as n, norm_line from line_hashes where norm_line is not null and line_nos is not null),
    records as (select distinct 'block' as kind, block_id::varchar as key, block_text as text from code_blocks where block_text is not null
        union all select 'file', file_path, string_agg(norm_line, chr(10) order by n, norm_line) from lines where n is not null group by file_path),
    windows as (select kind, key, i, substring(text, i, 200) as w from (select *, unnest(generate_series(1, length(text) - 199)) as i from records where length(text) >= 200)),
    shared as (select * from windows where (kind, w) in (select (kind, w) from windows group by kind, w having count(distinct key) > 1))"""
SQL["p2_found"] = f"{_WINDOWS} select distinct kind as record_kind, key as record_key from shared"
SQL["p2_shares"] = f"""{_WINDOWS}, covered as (select kind, key, sum(least(200, coalesce(next - i, 200))) as n from (select kind, key, i, lead(i) over (partition by kind, key order by i) as next from shared) group by all)
    select kind as record_kind, key as record_key, length(text) as n_characters, coalesce(n, 0)::bigint as n_shared, case when length(text) > 0 then round(coalesce(n, 0) / length(text), 6) else 0 end as shared_share
    from records left join covered using (kind, key)"""


# Problem 3: top N items within every group

ISSUES_PER_FILE, ENTRIES_PER_CRATE = 3, 5


def _worst_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lower(F.trim("severity"))
    rank = F.when(kind == "nuclear", 0).when(kind == "spicy", 1).when(kind == "mild", 2)
    return top_n_per_group(table(spark, sf_dir, "issues"), F.col("file_path"), [(rank, True)], F.col("issue_id"), ISSUES_PER_FILE)


def _highest_shame(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "shame_entries")
    order = [(F.col("shame_score"), False), (F.coalesce("file_path", F.lit("")), True)]
    return top_n_per_group(entries, F.col("crate_name"), order, F.col("entry_id"), ENTRIES_PER_CRATE)


@_query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {"issue": _worst_issues(spark, sf_dir), "shame": _highest_shame(spark, sf_dir)}
    issue, shame = (df.select(F.lit(name).alias("list_name"), "group_key", "item_id") for name, df in lists.items())
    return issue.unionByName(shame)


@_query
def p3_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lists with the exact position of each item."""
    lists = {"issue": _worst_issues(spark, sf_dir), "shame": _highest_shame(spark, sf_dir)}
    issue, shame = (df.select(F.lit(name).alias("list_name"), "group_key", "item_id", "position") for name, df in lists.items())
    return issue.unionByName(shame)


_LISTS = """select 'issue' as list_name, file_path as group_key, issue_id as item_id, row_number() over (partition by file_path order by rank, issue_id) as position
    from (select distinct file_path, issue_id, case lower(trim(severity)) when 'nuclear' then 0 when 'spicy' then 1 when 'mild' then 2 end as rank from issues)
    where rank is not null and file_path is not null qualify position <= 3
    union all
    select 'shame', crate_name, entry_id, row_number() over (partition by crate_name order by shame_score desc, file_path, entry_id) as position
    from (select distinct crate_name, entry_id, shame_score, coalesce(file_path, '') as file_path from shame_entries)
    where shame_score is not null and not isnan(shame_score) and crate_name is not null qualify position <= 5"""
SQL["p3_found"] = f"select list_name, group_key, item_id from ({_LISTS})"
SQL["p3_positions"] = _LISTS


# Problem 4: generated, minified or vendored source files


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("source_files", "file_labels", "exclude_patterns")
    files, labels, patterns = (table(spark, sf_dir, n) for n in names)
    return file_kinds(files, F.col("file_id"), F.col("file_path"), F.col("content"), labels, patterns)


@_query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).where("label <> 'handwritten'").select(F.col("id").alias("file_id"))


@_query
def p4_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of every file and the belief in it."""
    return _kinds(spark, sf_dir).select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "label", F.round("belief", 6).alias("belief"))


# Problem 5: near-duplicate records with small edits

SHINGLE, SIMILAR, FEWEST_TOKENS = 3, 0.6, 20


def _near_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(table(spark, sf_dir, "code_blocks"), F.col("block_id"), F.col("block_text"), SHINGLE, SIMILAR, FEWEST_TOKENS)


@_query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = all_pairs(*_near_blocks(spark, sf_dir))
    return pairs.select(F.col("a").alias("block_id_a"), F.col("b").alias("block_id_b"))


@_query
def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block long enough to be compared, with its class of copies, its group and its number of links."""
    return duplicate_groups(*_near_blocks(spark, sf_dir)).withColumnRenamed("id", "block_id")


_PAIRS = """t as (select distinct block_id, regexp_extract_all(lower(block_text), '[a-z0-9_]+') as k from code_blocks),
    s as (select distinct block_id, k[i] || ' ' || k[i + 1] || ' ' || k[i + 2] as s from (select *, unnest(generate_series(1, len(k) - 2)) as i from t where len(k) >= 20)),
    n as (select block_id, count(*) as n from s group by 1),
    p as (select x.block_id as a, y.block_id as b, count(*) as c from s x join s y on x.s = y.s and x.block_id < y.block_id group by 1, 2),
    found as (select a, b from p join n x on a = x.block_id join n y on b = y.block_id where c >= 0.6 * (x.n + y.n - c))"""
SQL["p5_found"] = f"with {_PAIRS} select a as block_id_a, b as block_id_b from found"
SQL["p5_groups"] = f"""with recursive {_PAIRS}, classes as (select block_id, min(block_id) over (partition by k) as class_id from (select block_id, list(s order by s) as k from s group by block_id)),
    links as (select a, b from found union all select b, a from found), reached(block_id, other) as (select block_id, block_id from n union select block_id, b from reached join links on other = a)
    select block_id, class_id, group_id, coalesce(n_links, 0) as n_links from classes join (select block_id, min(other) as group_id from reached group by 1) using (block_id)
    left join (select a as block_id, count(*) as n_links from links group by 1) using (block_id)"""


# Problem 6: encoding with a public tokenizer


@_query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), "byte_bpe_50k")


@_query
def p6_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; a null text comes back as the empty one."""
    return decode_ids(p6_ids(spark, sf_dir), F.col("doc_id"), F.col("ids"))


SQL["p6_decode"] = "select doc_id, coalesce(text, '') as text from documents"


# Problem 7: mixing sources to target weights


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    sized = token_sizes(documents, F.col("doc_id"), F.col("source"), F.col("text"))
    return weighted_mix(sized, table(spark, sf_dir, "mix_targets"))


@_query
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)


@_query
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shares(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


# Problem 8: repetition inside a single document

REPEATED = 0.30


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_shares(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))


@_query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir).where(F.col("repeated_share") >= REPEATED - 1e-12).select("doc_id")


@_query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of repeated content of every document."""
    return _shares(spark, sf_dir)


@_query
def p8_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity and whether its language's band rejects it."""
    return perplexity_bands(perplexities(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("lang"), F.col("text")))


_SHARES = """with t as (select doc_id, lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ')) as t from documents),
    g as (select doc_id, substring(t, i, 20) as s from (select doc_id, t, unnest(generate_series(1, length(t) - 19)) as i from t where length(t) >= 200)),
    r as (select doc_id, 1 - count(distinct s)::double / count(*) as share from g group by 1)
    select documents.doc_id, coalesce(share, 0) as repeated_share from documents left join r using (doc_id)"""
SQL["p8_shares"] = _SHARES
SQL["p8_found"] = f"select doc_id from ({_SHARES}) where repeated_share >= 0.3 - 1e-12"
