"""One query for each operator, over whole tables, and SQL where it can express the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, chunks, decontaminate, fingerprint, jaccard, linededup, quality, tokencount, turn_queries, warc  # noqa: F401
from .registry import BLANK, LOWER, ORACLES, QUERIES, UPPER, query, table, tokenizer_file  # noqa: F401


@query()
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(f"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from split),
keyed as (select *, translate(trim(line, {BLANK}), '{UPPER}', '{LOWER}') as key from lines),
common as (select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
marked as (select k.*, c.key is not null as gone from keyed k left join common c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from marked group by doc_id""")
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Drop the lines that ten or more documents share."""
    out = linededup.drop_common_lines(table(spark, folder, "documents"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("doc.text", 256).alias("kept_sha256"))


@query(r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'UP', 'LOW'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, array_to_string(words[i:i + 3], ' ') as g from
  (select doc_id, words, unnest(generate_series(1, greatest(len(words) - 3, 1))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
f as (select g from s group by g having count(*) > 1),
t as (select s.* from s join f using (g)),
o as (select x.doc_id as a, y.doc_id as b, count(*) as o from t x join t y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from o join n p on p.doc_id = a join n q on q.doc_id = b where 100 * o >= 85 * (p.n + q.n - o)),
r(doc_id, c) as (select a, a from e union select r.doc_id, e.b from r join e on e.a = r.c),
m as (select doc_id, min(c) as c from r group by doc_id),
l as (select a as doc_id, count(*) as n_links from e group by 1),
k as (select a as doc_id, min(b) as same from o join n p on p.doc_id = a join n q on q.doc_id = b where o = p.n and o = q.n group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) as component_id,
  least(w.doc_id, coalesce(k.same, w.doc_id)) as class_id, coalesce(l.n_links, 0) as n_links
from w left join n using (doc_id) left join m using (doc_id) left join l using (doc_id) left join k using (doc_id)""".replace("UP", UPPER).replace("LOW", LOWER))
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Links of documents whose four-word shingle sets have a Jaccard similarity of 0.85 or more: how many, and components."""
    return jaccard.with_links(table(spark, folder, "documents"), n=4, percent=85)


@query()
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram token counts of every text."""
    return tokencount.count_tokens(table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query()
def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Sketch every text and its edited text; compare them, and the next document."""
    rows = fingerprint.with_next(table(spark, folder, "documents"))
    rows = rows.withColumn("changed", fingerprint.edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2("changed", 256))
    for c in ("text", "changed", "next_text"):
        rows = fingerprint.with_sketch(rows, c, f"s_{c}").drop(c)
    own = F.col("s_text")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint.as_text(own).alias("fingerprint"),
                       fingerprint.as_text(F.col("s_changed")).alias("edited_fingerprint"),
                       fingerprint.resemblance(own, F.col("s_changed")).alias("near_edited"),
                       fingerprint.resemblance(own, F.col("s_next_text")).alias("near_next"),
                       fingerprint.distinct(own).alias("distinct_shingles"))


@query()
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated passages of every text."""
    return chunks.repeats(table(spark, folder, "documents"))


@query()
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Score every text; labels of held-out rows are not learnt from."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = quality.scored(docs, quality.fit(docs, table(spark, folder, "labels")))
    return rows.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as digest from pages),
k as (select digest, max(page_id) as keeper from p where strlen(html) >= 1000 group by digest)
select p.page_id, strlen(p.html) as payload_bytes, p.digest as payload_digest,
  case when k.keeper <> p.page_id then 'revisit' else 'response' end as record_type,
  case when k.keeper <> p.page_id then k.keeper end as refers_to
from p left join k on p.digest = k.digest and strlen(p.html) >= 1000""")
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Write the pages into archives and read them back."""
    return warc.round_trip(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encode and decode every text."""
    return bpe.tokenize(table(spark, folder, "documents"), tokenizer_file())


ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '[INST]', '&#91;INST]'), '[/INST]', '&#91;/INST]'), '<s>', '&lt;s>'), '</s>', '&lt;/s>')"


@query(f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(23 + length(replace({ESCAPED.format('role')}, chr(10), '&nl;')) + length({ESCAPED.format('text')}))::bigint as formatted_chars
from t group by conv_id""")
def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Format all conversations, and one full of control strings; read turns and loss text back from the output."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    turns = chat.canonical_turns(rows, F.to_variant_object(F.struct("role", "text")), "conv_id", "turn")
    out = chat.format_conversations(turns, "conv_id", "turn", "place")
    read = chat.read_turns(F.col("formatted"))
    out = out.withColumn("turns", read).withColumn("under", chat.loss_text(F.col("formatted"), F.col("loss")))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
                      F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))
