"""Query of the phrase mining, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegauge.llm.common import table
from tablegauge.llm.phrases import mine_phrases


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of all documents."""
    return mine_phrases(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Every phrase of up to five words by windows over the words of each piece.
SQL = r"""
with pieces as (
  select lang, row_number() over () as piece, words from (
    select lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as words from (
      select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents))
  where len(words) > 0),
grams as (
  select lang, w, k, count(*) as f from (
    select lang, list_slice(words, i, i + k - 1) as w, k from (
      select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from pieces, (values (1), (2), (3), (4), (5)) as sizes(k) where len(words) >= k))
  group by lang, w, k),
totals as (select lang, sum(len(words)) as n from pieces group by lang),
often as (select * from grams where f >= 100),
inside as (
  select lang, list_slice(w, i, i + m - 1) as w, max(f) as widest from (
    select lang, w, f, m, unnest(range(1, k - m + 2)) as i from (select lang, w, k, f, unnest(range(2, k)) as m from often where k > 2))
  group by all),
cuts as (
  select o.lang, o.w, o.f as a, t.n, cut, h.f as l, r.f as r, (1000::hugeint * o.f * t.n) // (h.f::hugeint * r.f) as score
  from (select *, unnest(range(1, k)) as cut from often where k > 1) o join totals t using (lang)
  join often h on h.lang = o.lang and h.w = list_slice(o.w, 1, cut) join often r on r.lang = o.lang and r.w = list_slice(o.w, cut + 1, o.k)
  where not exists (select 1 from inside i where i.lang = o.lang and i.w = o.w and 100 * i.widest >= 100 * o.f)),
best as (select * from (select *, row_number() over (partition by lang, w order by score, cut) as nth from cuts) where nth = 1),
ranked as (select *, array_to_string(w, ' ') as phrase, row_number() over (partition by lang order by score desc, a desc, array_to_string(w, ' ')) as rank from best)
select lang, rank::int as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""

QUERIES = {"op11_phrase_collocations": op11_phrase_collocations}
ORACLES = {"op11_phrase_collocations": SQL}
