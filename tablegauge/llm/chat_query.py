"""Query of the chat operator, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegauge.llm.chat import format_conversations
from tablegauge.llm.common import table


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return format_conversations(table(spark, sf_dir, "conversations"))


SQL = """
with said as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
whole as (
  select conv_id, count(*) as n_turns,
         string_agg(role || chr(31) || text || chr(30), '' order by turn nulls first) as body,
         string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by turn nulls first) as text
  from said group by conv_id),
one as (
  select min(conv_id) as conv_id, n_turns, count(*) as n_copies, body, text
  from whole group by n_turns, body, text)
select a.conv_id, a.n_turns, a.n_copies, a.text
from one a
where not exists (select 1 from one b where b.n_turns > a.n_turns and starts_with(b.body, a.body))
"""

QUERIES = {"op3_chat_formatting": op3_chat_formatting}
ORACLES = {"op3_chat_formatting": SQL}
