"""Registered queries of the operators on conversations' structure and on shards, with the parameters of their contracts,
and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotables.llm.common import table
from geotables.llm.prefix_trie import prefix_trie
from geotables.llm.sharding import place
from geotables.llm.structure_repair import digests, repair_report, repaired_rows

#: CRC-32 in SQL: the table of 256 remainders by its rule, and the checksum of a hexadecimal string {h} of bytes.
CRC_TABLE = "select list(list_reduce([x] || range(8), lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) order by x) as t from (select unnest(range(256)) as x)"
CRC = ("xor(list_reduce([4294967295::bigint] || list_transform(string_split(regexp_replace({h}, '(..)', '0x\\1 ', 'g'), ' ')"
       "[:strlen({h}) // 2], lambda b: b::bigint), lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)])), 4294967295)")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, each rebuilt to start with turns of the conversation whose id ends its group of five."""
    return prefix_trie(table(spark, sf_dir, "conversations"), "conv_id - conv_id % 5", "crc32(cast(conv_id as string)) % 9")


OP11_SQL = rf"""
with tab as ({CRC_TABLE}),
rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos,
        strlen(text) as bytes, sha256(length(role) || ':' || role || text) as digest from rows),
c as (select conv_id, conv_id - conv_id % 5 as base, {CRC.format(h="hex(encode(conv_id::varchar))")} % 9 as h
      from (select distinct conv_id from t), tab),
r as (select c.conv_id, pos, bytes, digest from c join t on t.conv_id = c.base and pos <= h
      union all select c.conv_id, pos, bytes, digest from c join t on t.conv_id = c.conv_id and pos > h),
paths as (select conv_id, row_number() over w as depth, string_agg(digest, '') over w as key, bytes from r
          window w as (partition by conv_id order by pos)
          union all select conv_id, 0, '', 0 from c),
nodes as (select key, depth, min(conv_id) as conv_id, count(*) as n_convs, min(bytes) as bytes from paths group by key, depth),
kids as (select substr(key, 1, 64 * (depth - 1)) as key, count(*) as n from nodes where depth > 0 group by 1),
v as (select nodes.*, coalesce(n, 0) as n_children from nodes left join kids using (key)),
sub as (select substr(key, 1, 64 * a) as key, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * bytes) as saved
        from (select *, unnest(generate_series(0, depth)) as a from v) group by 1),
ends as (select key, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as h
         from (select conv_id, max_by(key, depth) as key from paths group by conv_id) group by key)
select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, n_leaves::bigint as n_leaves,
  saved::bigint as saved_tokens, coalesce(h, sha256('')) as ends_sha256
from v join sub using (key) left join ends using (key)
left join nodes p on v.depth > 0 and p.key = substr(v.key, 1, 64 * (v.depth - 1))
"""

N_SHARDS = 8


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among eight equal shards, and its shard among nine."""
    placed = place(table(spark, sf_dir, "documents"), [1.0] * N_SHARDS, [1.0] * (N_SHARDS + 1))
    return placed.selectExpr("doc_id", "size", "text_crc32", "'key' as law", "shard", "slot", "grown_shard")


#: Equal weights: the largest draw wins, so the digits of the MD5 can be compared as they are.
OP12_SQL = rf"""
with tab as ({CRC_TABLE}),
d as (select doc_id, coalesce(strlen(text), 0) + 1 as size, {CRC.format(h="hex(encode(coalesce(text, '')))")} as text_crc32,
        coalesce(length(doc_id::varchar) || ':' || doc_id::varchar, '-') as key from documents, tab),
s as (select doc_id, size, text_crc32,
        list_sort(list_transform(range({N_SHARDS}), lambda i: {{'at': substr(md5('shard:' || i || ':' || key), 1, 13), 'no': -i}}))[-1].no as a,
        list_sort(list_transform(range({N_SHARDS + 1}), lambda i: {{'at': substr(md5('shard:' || i || ':' || key), 1, 13), 'no': -i}}))[-1].no as b
      from d)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, (-a)::int as shard,
  row_number() over (partition by a order by doc_id nulls first, text_crc32, size) - 1 as slot, (-b)::int as grown_shard
from s
"""

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with the damage of the contract, by the checksum of conv_id and turn: a row of 20 is dropped, one emptied,
    one loses its sentence ends, one is repeated and one becomes a user's."""
    text = "coalesce(cast({} as string), ' ')"
    rows = conversations.selectExpr(
        "conv_id", "turn", "coalesce(role, ' ') as role", "coalesce(text, ' ') as text",
        f"crc32(concat({text.format('conv_id')}, ':', {text.format('turn')})) % 20 as kind").where("kind <> 0")
    return rows.selectExpr(
        "conv_id", "turn", "if(kind = 4, 'user', role) as role",
        "case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text",
        "explode(if(kind = 3, array(1, 2), array(1))) as copy").drop("copy")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of all conversations, after the damage of the contract."""
    conversations = table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    report, edits = repair_report(rows)
    found = report.withColumnRenamed("conv_id", "_id")
    texts = digests(repaired_rows(rows, edits)).withColumnRenamed("conv_id", "_text_id")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.expr("conv_id <=> _id"), "left").join(texts, F.expr("conv_id <=> _text_id"), "left")
    return joined.selectExpr("conv_id", *[f"coalesce({c}, 0L) as {c}" for c in COUNTS], "coalesce(audit, '') as audit",
                             "coalesce(repaired_sha256, sha2('', 256)) as repaired_sha256")


def _add(value: str, cost: int | str, edit: str) -> str:
    return f"(lpad(({value}[:8]::int + {cost})::varchar, 8, '0') || {value}[9:] || '{edit}')"


def _row_step() -> str:
    """One row of the dynamic programme: w are the four states before it (cost in eight digits, then edits; null: not reached),
    after insertions, and r the row (initial, fault)."""
    def stays(states: list[int], initial: str) -> list[str]:
        cost = "case r[2] when '3' then 5 else 0 end"
        kept = [f"case when r[2] in ('0', '3') and r[1] = '{initial}' then {_add(f'w[{s}]', cost, 'K')} end" for s in states]
        made = [f"case when r[2] in ('0', '3') then {_add(f'w[{s}]', f'1 + {cost}', 'R')} end" for s in states]
        return kept + (made if initial != "s" else [])
    gone = [_add(f"w[{s}]", 2, "D") for s in (1, 2, 3, 4)]
    after = [gone[0], f"least({', '.join([gone[1], *stays([1], 's')])})",
             f"least({', '.join([gone[2], *stays([1, 2, 4], 'u')])})", f"least({', '.join([gone[3], *stays([3], 'a')])})"]
    return f"[{', '.join(after)}]"


def _inserted(v: str, then: str) -> str:
    """``then`` of w, the states of v and what insertions make of them."""
    user = ", ".join(_add(f"v[{s}]", 5, "I") for s in (1, 2, 4))
    return (f"list_transform([{v}], lambda v: list_transform([[v[1], v[2], least(v[3], {user}), v[4]]], lambda u: "
            f"list_transform([[u[1], u[2], u[3], least(u[4], {_add('u[3]', 5, 'I')})]], lambda w: {then})[1])[1])[1]")


#: A dynamic programme over the rows of a conversation, by the least (cost, edits) of each state.
OP13_SQL = rf"""
with tab as ({CRC_TABLE}),
o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {CRC.format(h="hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')))")} % 20 as kind
      from conversations, tab),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
        unnest(case when kind = 3 then [1, 2] else [1] end) as copy from o where kind <> 0),
r as (select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as said,
        row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from d),
s as (select *, row_number() over (partition by conv_id, role, text order by pos) as seen from r),
k as (select conv_id, pos, turn, role, text, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'x' end as i,
        case when said = '' then '1' when seen > 1 then '2' when right(said, 1) not in ('.', '!', '?') then '3' else '0' end as f
      from s),
n as (select *, lead(i) over (partition by conv_id order by pos) as after from k),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where f = '1') as blank,
        count(*) filter (where f = '2') as duplicate, count(*) filter (where f = '3') as truncated,
        count(*) filter (where after is not null and i || after not in ('su', 'ua', 'au')) as illegal,
        list_reduce([['00000000', null, null, null]] || list([i, f] order by pos), lambda v, r: {_inserted('v', _row_step())}) as v
      from n group by conv_id),
b as (select * exclude (v), {_inserted('v', 'least(w[1], w[4])')} as best from c),
a as (select *, best[9:] as audit from b),
e as (select conv_id, unnest(range(1, length(audit) + 1)) as j, audit from a),
x as (select conv_id, j, substr(audit, j, 1) as op, count(*) filter (where substr(audit, j, 1) <> 'I') over (partition by conv_id order by j)
        as pos from e),
y as (select x.conv_id, j, op, k.role, case when op = 'I' then '' else k.text end as text,
        row_number() over (partition by x.conv_id order by j) as place,
        first_value(op = 'K' and i = 's') over (partition by x.conv_id order by j) as head
      from x left join k on k.conv_id is not distinct from x.conv_id and k.pos = x.pos where op <> 'D'),
z as (select conv_id, sha256(string_agg(case when op = 'K' then role when (place - head::int) % 2 = 1 then 'user' else 'assistant' end
        || ':' || text, chr(10) order by place)) as h from y group by conv_id),
every as (select distinct conv_id from conversations)
select every.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best[:8]::bigint, 0) as cost,
  coalesce(audit, '') as audit, coalesce(h, sha256('')) as repaired_sha256
from every left join a on a.conv_id is not distinct from every.conv_id left join z on z.conv_id is not distinct from every.conv_id
"""

QUERIES = {"op11_prefix_trie": op11_prefix_trie, "op12_sharding": op12_sharding, "op13_structure_repair": op13_structure_repair}
ORACLE = {"op11_prefix_trie": OP11_SQL, "op12_sharding": OP12_SQL, "op13_structure_repair": OP13_SQL}
