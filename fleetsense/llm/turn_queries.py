"""Queries of the operators on conversations and fingerprints that came last, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prefixtrie, repair, simhash
from .registry import LOWER, UPPER, query, table

#: crc32 of a string of ASCII characters, by a table of 256 entries; `crc_table` has to be in scope as t.
CRC_TABLE = """crc_table as (select list(v order by i) as crc from (select i, list_reduce(range(8),
  lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, i) as v from range(256) as r(i)))"""


def crc32(text: str) -> str:
    return (f"xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint), "
            "lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295)")


# The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def wrap(x: str) -> str:
    """Modulo 2^64; products of two 64-bit numbers fit into UHUGEINT."""
    return f"(({x}) & 18446744073709551615::uhugeint)"


def times(x: str, prime: int, plus: int = 0) -> str:
    return wrap(f"{x} * {prime}::uhugeint + {plus}::uhugeint")


def rotated(x: str, r: int) -> str:
    return f"({wrap(f'({x} << {r}::uhugeint)')} | ({x} >> {64 - r}::uhugeint))"


def number(digits: str) -> str:
    """Little-endian bytes, as hex digits, to a number: reversed digits with the digits of each byte swapped back."""
    x = f"('0x' || reverse({digits}))::ubigint"
    return f"((({x} & 17361641481138401520) >> 4) | (({x} & 1085102592571150095) << 4))::uhugeint"


def mixed_in(acc: str, lane: str) -> str:
    return times(rotated(wrap(f"{acc} + {lane} * {P2}::uhugeint"), 31), P1)


def merged(h: str, v: str) -> str:
    return times(f"xor({h}, {mixed_in('0::uhugeint', v)})", P1, P4)


def stripes(first: int, seed: int) -> str:
    return f"list_reduce(w[{first}:4 * (n // 32):4], lambda a, x: {mixed_in('a', 'x')}, {seed % (1 << 64)}::uhugeint)"


def eight(k: int) -> str:
    """h after the k-th whole lane behind the stripes."""
    lane = number(f"hx[n // 32 * 64 + {16 * k - 15}:n // 32 * 64 + {16 * k}]")
    return f"case when n // 8 % 4 >= {k} then {times(rotated(f'xor(h, {mixed_in('0::uhugeint', lane)})', 27), P1, P4)} else h end as h"


def one(k: int) -> str:
    """h after the k-th of the last bytes."""
    byte = f"('0x' || hx[n // 4 * 8 + {2 * k - 1}:n // 4 * 8 + {2 * k}])::ubigint::uhugeint"
    return f"case when n % 4 >= {k} then {times(rotated(f'xor(h, {times(byte, P5)})', 11), P1)} else h end as h"


WORD = times(number("hx[n // 8 * 16 + 1:n // 8 * 16 + 8] || '00000000'"), P1)
FOUR = f"case when n % 8 >= 4 then {times(rotated(f'xor(h, {WORD})', 23), P2, P3)} else h end as h"
MIX = wrap(" + ".join(rotated(v, r) for v, r in (("v1", 1), ("v2", 7), ("v3", 12), ("v4", 18))))

#: From grams (doc_id, g) to hashed (doc_id, h): XXH64 of g in UTF-8 with seed 42.
XXH64 = f"""
digits as (select doc_id, strlen(g)::bigint as n, lower(hex(encode(g))) as hx from grams),
long as (select *, {stripes(1, 42 + P1 + P2)} as v1, {stripes(2, 42 + P2)} as v2, {stripes(3, 42)} as v3, {stripes(4, 42 - P1)} as v4
  from (select *, list_transform(range(n // 32 * 4), lambda k: {number('hx[k * 16 + 1:k * 16 + 16]')}) as w from digits where n >= 32)),
begun as (select doc_id, n, hx, {wrap(f'42 + {P5}::uhugeint + n::uhugeint')} as h from digits where n < 32
  union all select doc_id, n, hx, {wrap('z + n::uhugeint')} from (select *, {merged('y', 'v4')} as z from (select *, {merged('x', 'v3')} as y from (select *, {merged('u', 'v2')} as x from
    (select *, {merged('s', 'v1')} as u from (select *, {MIX} as s from long)))))),
eight1 as (select doc_id, n, hx, {eight(1)} from begun), eight2 as (select doc_id, n, hx, {eight(2)} from eight1), eight3 as (select doc_id, n, hx, {eight(3)} from eight2),
fours as (select doc_id, n, hx, {FOUR} from eight3),
one1 as (select doc_id, n, hx, {one(1)} from fours), one2 as (select doc_id, n, hx, {one(2)} from one1), ones as (select doc_id, {one(3)} from one2),
last as (select doc_id, {times('xor(h, h // 8589934592::uhugeint)', P2)} as h from ones),
later as (select doc_id, {times('xor(h, h // 536870912::uhugeint)', P3)} as h from last),
hashed as (select doc_id, xor(h, h // 4294967296::uhugeint)::ubigint as h from later)"""


@query(f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as words from documents),
grams as (select doc_id, array_to_string(words[i:i + 2], ' ') as g from (select doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) as i from w where len(words) > 0)),
{XXH64},
bits as (select doc_id, {' + '.join(f"case when 2 * sum((h >> {k}) & 1) > count(*) then {1 << k}::uhugeint else 0 end" for k in range(64))} as f from hashed group by doc_id),
prints as (select w.doc_id, coalesce(f, 0)::ubigint as f from w left join bits using (doc_id)),
nodes as (select f, min(doc_id) as head from prints group by f),
edges as (select a.f as a, b.f as b from nodes a join nodes b on bit_count(xor(a.f, b.f)) <= 3),
reached(f, g) as (select f, f from nodes union select r.f, e.b from reached r join edges e on e.a = r.g),
named as (select r.f, min(n.head) as component_id from reached r join nodes n on n.f = r.g group by r.f)
select doc_id, printf('%016x', f) as fingerprint, component_id from prints join named using (f)""")
def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 64-bit fingerprints of three-word shingles differ in at most three bits."""
    return simhash.near_duplicates(table(spark, folder, "documents"), n=3, most=3)


@query(f"""
with {CRC_TABLE},
turns as (select conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) as m, row_number() over (partition by conv_id order by turn nulls first,
  sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), strlen(coalesce(text, ''))) as i from conversations where conv_id is not null),
own as (select conv_id, list(m order by i) as a from turns group by conv_id),
drawn as (select conv_id, a, {crc32('conv_id::varchar')} % 9 as h from own, crc_table),
rebuilt as (select x.conv_id, list_concat(coalesce(b.a[:x.h], []), x.a[x.h + 1:]) as p from drawn x left join own b on b.conv_id = x.conv_id - x.conv_id % 5),
beginnings as (select conv_id, d, p[:d] as q, d = len(p) as whole from (select conv_id, p, unnest(range(len(p) + 1)) as d from rebuilt)),
nodes as (select d, q, min(conv_id) as conv_id, count(*) as n, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where whole), '')) as ends
  from beginnings group by d, q),
children as (select d - 1 as d, q[:d - 1] as q, count(*) as k from nodes where d > 0 group by 1, 2),
known as (select n.*, coalesce(k, 0) as k, case when n.d = 0 then 0 else (n - 1) * strlen(n.q[n.d].t) end as own from nodes n left join children c on c.d = n.d and c.q = n.q),
under as (select up, q[:up] as q, count(*) filter (where k = 0) as leaves, sum(own) as saved from (select *, unnest(range(d + 1)) as up from known) group by 1, 2)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n as n_convs, n.k as n_children, u.leaves as n_leaves, u.saved::bigint as saved_tokens, n.ends as ends_sha256
from known n join under u on u.up = n.d and u.q = n.q left join nodes p on p.d = n.d - 1 and p.q = n.q[:n.d - 1]""")
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return prefixtrie.trie(prefixtrie.spliced(prefixtrie.turn_lists(table(spark, folder, "conversations"))))


@query(f"""
with recursive {CRC_TABLE},
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as kind
  from conversations, crc_table),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
  case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from keyed, range(2) as c(copy) where kind <> 0 and (kind = 3 or copy = 0)),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
placed as (select *, row_number() over (partition by conv_id, role, text order by i) as nth from numbered),
rows as (select *, role[1] as x, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'b' when nth > 1 then 'd'
  when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 't' else '' end as fault,
  i > 1 and not coalesce(lag(role[1]) over (partition by conv_id order by i) || role[1], '') in ('su', 'ua', 'au') as wrong from placed),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'b') as blank, count(*) filter (where fault = 'd') as duplicate,
  count(*) filter (where fault = 't') as truncated, count(*) filter (where wrong) as illegal, max(i) as n from rows group by conv_id),
next(s, t, name) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
inserts(s, t, cost, audit, made) as (select s, s, 0, '', []::varchar[] from next union all select a.s, b.t, a.cost + 5, a.audit || 'I', list_append(a.made, b.name || ':')
  from inserts a join next b on b.s = a.t where a.cost < 15),
keeps(s, x, t) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
all_ids as (select distinct conv_id from conversations),
ways(conv_id, i, s, best) as (
  select conv_id, 0::bigint, 0, row(0, '', []::varchar[]) from all_ids
  union all
  select conv_id, i, t, min(row(cost, audit, made)) from (
    select w.conv_id, r.i, e.t, w.best[1] + p.cost + e.cost as cost, w.best[2] || p.audit || e.letter as audit, list_concat(list_concat(w.best[3], p.made), e.made) as made
    from ways w join rows r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1 join inserts p on p.s = w.s,
    lateral (select p.t as t, 2 as cost, 'D' as letter, []::varchar[] as made
      union all select t, 1 + case r.fault when 't' then 5 else 0 end, 'R', [name || ':' || r.text] from next where next.s = p.t and r.fault in ('', 't')
      union all select t, case r.fault when 't' then 5 else 0 end, 'K', [r.role || ':' || r.text] from keeps where keeps.s = p.t and keeps.x = r.x and r.fault in ('', 't')) e)
  group by conv_id, i, t),
ends as (select w.conv_id, min(row(w.best[1] + p.cost, w.best[2] || p.audit, list_concat(w.best[3], p.made))) as best from ways w left join counts c on c.conv_id is not distinct from w.conv_id
  join inserts p on p.s = w.s where w.i = coalesce(c.n, 0) and p.t in (0, 3) group by w.conv_id)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  best[1]::bigint as cost, best[2] as audit, sha256(coalesce(array_to_string(best[3], chr(10)), '')) as repaired_sha256
from ends e left join counts c on c.conv_id is not distinct from e.conv_id""")
def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Damage all conversations, report their faults and the cheapest repair."""
    rows = repair.damaged(table(spark, folder, "conversations"))
    return repair.report(rows, F.col("present")).drop("n_rows")
