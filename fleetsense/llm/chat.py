"""Chat formatting: heterogeneous records to canonical turns to one marked text, as DataFrame expressions only.

A record's fingerprint is the hash of the sorted nested field paths that its schema has in full of the most specific known
layout, so additional fields do not matter, also those of other layouts. The fingerprint selects a declarative layout:
either single fields with the role they stand for, or a list of messages with a role field and a text field. Most specific
is: a list of messages before single fields, then more paths before fewer, then the order of LAYOUTS. An empty list of
messages is a record of that layout without turns.

Null roles and texts are empty. Turns with the same number follow each other by role and text. A conversation's formatted
text is one value by nature: it must fit into a row. Records of no known layout have the layout null and no turns.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The layouts, and what other names of roles mean.
LAYOUTS = {
    "messages": {"list": "$.messages", "role": "role", "text": "content"},
    "from_value": {"list": "$.conversations", "role": "from", "text": "value"},
    "prompt_completion": {"turns": [("user", "$.prompt"), ("assistant", "$.completion")]},
    "prompt_response": {"turns": [("user", "$.prompt"), ("assistant", "$.response")]},
    "system_prompt_response": {"turns": [("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")]},
    "question_answer": {"turns": [("user", "$.question"), ("assistant", "$.answer")]},
    "instruction": {"turns": [("user", "$.instruction"), ("assistant", "$.output")]},
    "instruction_input": {"turns": [("user", "$.instruction", "$.input"), ("assistant", "$.output")]},
    "turn_row": {"turns": [("$.role", "$.text")]},
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

# The marks of the template, and the escapes of what could be taken for one.
OPEN, MIDDLE, CLOSE = "<s>[INST] ", "\n", " [/INST]</s>"
ESCAPES = [("&", "&amp;"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>")]


def paths_of(layout: dict) -> list[str]:
    """The nested field paths that a layout reads."""
    if "list" in layout:
        return sorted(f"{layout['list']}[0].{layout[x]}" for x in ("role", "text"))
    return sorted({p for turn in layout["turns"] for p in turn if p.startswith("$.")})


def specific(name: str) -> tuple[bool, int]:
    """Sort key: the most specific layouts first; equal ones stay in order."""
    return "list" not in LAYOUTS[name], -len(paths_of(LAYOUTS[name]))


def fingerprint(record: Column) -> Column:
    """Hash of the paths of the most specific layout that a record (variant) has in full; a field that is there and null
    counts. Null if there is none."""
    out = F.when(F.lit(False), F.lit(""))
    for name in sorted(LAYOUTS, key=specific):
        there = [F.try_variant_get(record, p, "variant").isNotNull() for p in paths_of(LAYOUTS[name])]
        has = reduce(and_, there)
        if "list" in LAYOUTS[name]:
            has = has | (F.size(F.try_variant_get(record, LAYOUTS[name]["list"], "array<variant>")) == 0)
        out = out.when(F.coalesce(has, F.lit(False)), F.lit("\n".join(paths_of(LAYOUTS[name]))))
    return F.sha1(out)


FINGERPRINTS = {hashlib.sha1("\n".join(paths_of(v)).encode()).hexdigest(): k for k, v in LAYOUTS.items()}


def text_at(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))


def turns_of(record: Column, layout: dict) -> Column:
    """array<struct<role, text>> by a layout."""
    if "list" in layout:
        items = F.try_variant_get(record, layout["list"], "array<variant>")
        return F.transform(items, lambda m: F.struct(canonical_role(text_at(m, f"$.{layout['role']}")).alias("role"), text_at(m, f"$.{layout['text']}").alias("text")))

    def turn(role: str, *paths: str) -> Column:
        texts = [text_at(record, p) for p in paths]
        text = texts[0] if len(texts) == 1 else F.array_join(F.filter(F.array(*texts), lambda x: x != ""), "\n\n")
        return F.struct((text_at(record, role) if role.startswith("$.") else F.lit(role)).alias("role"), text.alias("text"))

    return F.array(*(turn(*t) for t in layout["turns"]))


def canonical_role(role: Column) -> Column:
    out = role
    for other, own in ROLES.items():
        out = F.when(role == other, F.lit(own)).otherwise(out)
    return out


def canonical_turns(records: DataFrame, record: Column, *keys: str) -> DataFrame:
    """keys, layout, place, role, text: the turns of each record (a variant column) by the layout of its fingerprint."""
    rows = records.select(*keys, record.alias("record_")).withColumn("mark_", fingerprint(F.col("record_")))
    turns = name = None
    for mark, known in FINGERPRINTS.items():
        this = F.col("mark_") == mark
        own = turns_of(F.col("record_"), LAYOUTS[known])
        turns = F.when(this, own) if turns is None else turns.when(this, own)
        name = F.when(this, F.lit(known)) if name is None else name.when(this, F.lit(known))
    rows = rows.select(*keys, name.alias("layout"), F.posexplode_outer(turns).alias("place", "turn_"))
    return rows.select(*keys, "layout", "place", F.col("turn_.role").alias("role"), F.col("turn_.text").alias("text"))


def escape(text: Column, line: bool = False) -> Column:
    for raw, safe in [*ESCAPES, *([("\n", "&nl;")] if line else [])]:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in [("\n", "&nl;"), ("[", "&#91;"), ("<", "&lt;"), ("&", "&amp;")]:
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_conversations(turns: DataFrame, key: str, *order: str) -> DataFrame:
    """key, formatted, loss (array of start and length, in code points, of the assistant's texts in formatted)."""
    head = F.concat(F.lit(OPEN), escape(F.col("role"), line=True), F.lit(MIDDLE))
    turns = turns.select(key, *order, *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    rows = turns.select("*", head.alias("head"), escape(F.col("text")).alias("safe"))
    rows = rows.withColumn("piece", F.concat("head", "safe", F.lit(CLOSE)))
    sort = [F.col(c) for c in (*order, "role", "text")]
    rows = (rows.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(*sort)))
            .withColumn("end", F.sum(F.length("piece")).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))))
    start = F.col("end") - F.length("piece") + F.length("head")
    span = F.when(F.col("role") == "assistant", F.struct(start.cast("int").alias("start"), F.length("safe").alias("length")))
    whole = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "piece", span.alias("span")))).alias("all"))
    return whole.select(key, F.array_join(F.transform("all", lambda t: t.piece), "").alias("formatted"),
                        F.array_compact(F.transform("all", lambda t: t.span)).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, "</s>", -1), lambda p: p != "")
    inner = F.transform(pieces, lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p) - len(OPEN) - len(CLOSE) + len("</s>")))
    return F.transform(inner, lambda p: F.struct(
        unescape(F.substring_index(p, MIDDLE, 1)).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, MIDDLE, 1)) + 2, F.length(p))).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s.start + 1, s.length))), "")
