"""Registered queries of the text operators, with the parameters of their contracts, and DuckDB SQL where it can say
the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotables.llm.bpe import decode_bpe, encode_bpe, n_tokens
from geotables.llm.chat_format import format_chat, read_back
from geotables.llm.common import held_out, table, written
from geotables.llm.decontaminate import contamination
from geotables.llm.html_text import extract_main_text
from geotables.llm.langid import fit_language, predict_language
from geotables.llm.line_dedup import dedup_lines
from geotables.llm.nearest import nearest
from geotables.llm.quality import fit_quality, score_quality, with_statistics
from geotables.llm.simhash import simhash_components
from geotables.llm.substring import remove_repeats
from geotables.llm import structure_queries as structure

SIMHASH_WORDS, SIMHASH_BITS = 4, 4


def tokenizer_path() -> str:
    """The public tokenizer file of the contracts, on the driver."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that start in a document with a smaller id."""
    out = remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of 13-word windows of benchmark items."""
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"),
                          table(spark, sf_dir, "benchmark").select("item_id", "text"), size=13)
    return found.selectExpr("doc_id", "n_words", "n_hit", "cast(size(items) as bigint) as n_items",
                            "sha2(array_join(items, ','), 256) as items_sha256", f"{CONTAMINATED} as contaminated")


OP2_SQL = r"""
with docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w, row_number() over () as k from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
sized as (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) as i from items where len(w) > 0),
win as (select distinct item_id, array_to_string(w[i:i + 12], ' ') as s, least(13, len(w)) as n from sized),
sizes as (select distinct n from win),
starts as (select k, doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from docs, sizes where len(w) >= n),
keyed as (select k, i, n, array_to_string(w[i:i + n - 1], ' ') as s from starts),
hits as (select distinct k, i, keyed.n, item_id from keyed join win using (s)),
places as (select k, count(distinct p) as n_hit from (select k, unnest(generate_series(i, i + n - 1)) as p from hits) group by k),
found as (select k, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
          from (select distinct k, item_id from hits) group by k)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join places using (k) left join found using (k)
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, read by learning and by scoring; rows held out teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = written(with_statistics(docs).drop("text"), "op3-statistics")
    model = fit_quality(stats, table(spark, sf_dir, "labels"), where=f"not {held_out()}")
    return score_quality(stats, model).selectExpr(
        "doc_id", f"{held_out()} as held_out", "score", "cast(score >= 0.7 as int) as predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows held out teach nothing."""
    docs = table(spark, sf_dir, "documents")
    network = fit_language(docs, where=f"not {held_out()}")
    found = predict_language(docs.select("doc_id", "text"), network).drop("text")
    return found.selectExpr("doc_id", f"{held_out()} as held_out", "lang_pred", "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text, then decode the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decode_bpe(encode_bpe(docs, tokenizer_path(), keep_text=False), tokenizer_path())
    return done.select("doc_id", n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    found = simhash_components(table(spark, sf_dir, "documents"), SIMHASH_WORDS, SIMHASH_BITS)
    return found.selectExpr("doc_id", "lower(lpad(hex(fingerprint), 16, '0')) as fingerprint", "component_id")


LINE_EDITS, LINE_CHARS = 2, 32


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that are equal to, or two edits or fewer away from, a line that occurs first earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, LINE_EDITS, LINE_CHARS).select(
        "doc_id", "n_lines", "n_removed", "n_near", "n_links", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: DuckDB's levenshtein counts bytes; the letters outside ASCII are turned into single control bytes for it.
OP7_SQL = r"""
with l as (
  select doc_id, i - 1 as pos, s[i] as line from (
    select doc_id, s, unnest(generate_series(1, len(s))) as i from (
      select doc_id, string_split(text, chr(10)) as s from documents where text is not null))),
d as (select line, length(line) as n, min((doc_id, pos)) as first, count(*) as copies,
        translate(line, 'éóèñüçêöäßíÉÈÑÓÜÄÖÇÊÍúáîâàùûôëïÁÚ', (select string_agg(chr(c::int), '' order by c) from
          (select unnest([1,2,3,4,5,6,7,8,14,15,16,17,18,19,20,21,22,23,24,25,26,27,28,29,30,31,36,94,96,126,64,127,92]) as c))) as t
      from l where length(line) >= 32 group by line),
near as (
  select a.line as la, b.line as lb, a.first as fa, b.first as fb from d a join d b
    on b.n between a.n - 2 and a.n + 2 and a.first < b.first
  where (contains(b.line, substr(a.line, 1, (a.n // 3)::int))
      or contains(b.line, substr(a.line, (a.n // 3 + 1)::int, (a.n // 3)::int))
      or contains(b.line, substr(a.line, (2 * (a.n // 3) + 1)::int)))
    and levenshtein(a.t, b.t) <= 2),
ends as (select lb as line, fa as other from near union all select la, fb from near),
info as (select d.line, first, min(other) as nearest, count(other) as degree from d left join ends using (line) group by all),
o as (select l.doc_id, l.pos, l.line, coalesce(first < (l.doc_id, l.pos), false) as copy,
        coalesce(nearest < (l.doc_id, l.pos), false) as near, coalesce(degree, 0) as degree
      from l left join info using (line))
select documents.doc_id, count(pos)::bigint as n_lines, count(*) filter (where copy or near)::bigint as n_removed,
  count(*) filter (where near and not copy)::bigint as n_near, coalesce(sum(degree), 0)::bigint as n_links,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not copy and not near), '')) as kept_sha256
from documents left join o using (doc_id) group by documents.doc_id
"""


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose two texts hold control strings."""
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)],
                                  "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_chat(rows)).selectExpr(
        "conv_id", "cast(size(turns) as bigint) as n_turns",
        r"sha2(array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), ''), 256) as turns_sha256",
        "cast(char_length(loss_text) as bigint) as loss_chars", "sha2(loss_text, 256) as loss_sha256",
        "cast(char_length(formatted) as bigint) as formatted_chars")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100, among all others."""
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


OP8_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select *, row_number() over w as k, lag(role) over w as before from c
      window w as (partition by conv_id order by turn nulls first, role, text)),
p as (select conv_id, k, role, text, coalesce(role = before, false) as same,
        replace(replace(replace(role, '\', '\0'), '<', '\1'), '[', '\2') as er,
        replace(replace(replace(text, '\', '\0'), '<', '\1'), '[', '\2') as et from o)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by k), '')) as loss_sha256,
  (4 + sum(length(et) + 13 + case when same then 0 else length(er) + 3 + case when k > 1 then 4 else 0 end end))::bigint
    as formatted_chars
from p group by conv_id
"""

QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_decontamination": op2_decontamination, "op3_quality_classifier": op3_quality_classifier, "op4_language_id": op4_language_id, "op5_bpe": op5_bpe, "op6_simhash": op6_simhash, "op7_line_dedup": op7_line_dedup, "op8_chat_formatting": op8_chat_formatting, "op9_html_extraction": op9_html_extraction,
           "op10_nearest": op10_nearest, **structure.QUERIES}
ORACLE = {"op2_decontamination": OP2_SQL, "op7_line_dedup": OP7_SQL, "op8_chat_formatting": OP8_SQL, **structure.ORACLE}
