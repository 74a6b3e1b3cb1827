"""Query of the decontamination operator, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegauge.llm.common import table
from tablegauge.llm.decontaminate import decontaminate


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, in windows of ten words."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_xxhash64")


WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL = f"""
with item as (select item_id, {WORDS} as w from benchmark),
sized as (select item_id, w, least(len(w), 10) as n from item where len(w) > 0),
spans as (
  select distinct item_id, n, array_to_string(w[i + 1 : i + n], ' ') as win
  from (select item_id, w, n, unnest(range(0, len(w) - n + 1)) as i from sized)),
doc as (select doc_id, {WORDS} as w from documents),
lengths as (select distinct n from spans),
tried as (
  select doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') as win
  from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as i from doc, lengths where len(w) >= n)),
hit as (select t.doc_id, t.n, t.i, t.win from tried t where exists (select 1 from spans s where s.n = t.n and s.win = t.win)),
covered as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
items as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as sha
  from (select distinct h.doc_id, cast(s.item_id as varchar) as item from hit h join spans s on s.n = h.n and s.win = h.win)
  group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(x.n_items, 0) as n_items,
       coalesce(x.sha, sha256('')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from doc d left join covered c using (doc_id) left join items x using (doc_id)
"""

QUERIES = {"op7_benchmark_decontamination": op7_benchmark_decontamination}
ORACLES = {"op7_benchmark_decontamination": SQL}
