"""Texts and turns cut until they fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import canonical_json
from tessera.operators import splitting
from tessera.plans.registry import query
from tessera.sources.tables import table

_ENDS = r"list_transform(range(1, len(l) + 1), lambda i: list_sum(l[1:i])::bigint)"
BISECT = rf"""with recursive s(doc_id, path, depth, text) as (select doc_id, '', 0, text from documents where text is not null
union all select doc_id, path || side, depth + 1, case side when '0' then substr(text, 1, o) else substr(text, o + 1) end
from (select doc_id, path, depth, text, coalesce(list_min(list_transform(list_filter({_ENDS}, lambda e: e > 0 and e < n), lambda e: abs(e - n // 2) * 10000000 + e)) % 10000000, n // 2) as o
  from (select *, length(text) as n, list_filter(list_transform(regexp_extract_all(text, '{splitting.PROSE}'), lambda p: length(p)), lambda k: k > 0) as l from s where length(text) > 1500 and depth < 3)), (values ('0'), ('1')) as v(side)),
leaf as (select * from s where length(text) <= 1500 or depth = 3)
select doc_id, row_number() over (partition by doc_id order by path) as piece, length(text) as n_chars, sha256(text) as sha from leaf"""


@query("t03_bisect", BISECT)
def bisect(spark, d):
    """Documents cut near the middle, at ends of sentences or lines, until pieces have 1,500 characters or are three cuts deep."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(splitting.bisected(F.col("text"), 1500)).alias("piece", "part"))
    return rows.select("doc_id", (F.col("piece") + 1).cast("long").alias("piece"), F.length("part").cast("long").alias("n_chars"), F.sha2("part", 256).alias("sha"))


# The JSON around a turn's text takes 26 characters and the role.
SPLIT = r"""with recursive t as (select conv_id, turn, text, 200 - 26 - length(role) as room from conversations),
u as (select conv_id, turn, room, i as pos, substr(text, i, 1) as c from t, unnest(range(1, length(text) + 1)) as r(i)),
w as (select *, case when c in ('"', '\', chr(8), chr(12), chr(10), chr(13), chr(9)) then 2 when c < ' ' then 6 else 1 end as w from u),
c as materialized (select conv_id, turn, room, pos, sum(w) over (partition by conv_id, turn order by pos) as cum from w union all select conv_id, turn, room, 0, 0 from t),
p(conv_id, turn, piece, start, stop) as (select conv_id, turn, 1, 0, max(pos) from c where cum <= room group by conv_id, turn
  union all select p.conv_id, p.turn, p.piece + 1, p.stop, max(c.pos) from p join c as s on s.conv_id = p.conv_id and s.turn = p.turn and s.pos = p.stop
    join c on c.conv_id = p.conv_id and c.turn = p.turn and c.pos > p.stop and c.cum - s.cum <= c.room group by p.conv_id, p.turn, p.piece, p.stop)
select conv_id, turn, piece, stop - start as n_chars, sha256(substr(text, start + 1, stop - start)) as sha from p join t using (conv_id, turn)"""


@query("t15_turn_split", SPLIT)
def turn_split(spark, d):
    """Turns as JSON objects of at most 200 characters, each with as much of the text as fits."""
    room = 200 - 26 - F.length("role")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(splitting.fitted(F.col("text"), room)).alias("piece", "part"))
    return rows.select("conv_id", "turn", (F.col("piece") + 1).alias("piece"), F.length("part").cast("long").alias("n_chars"), F.sha2("part", 256).alias("sha"))


@query("h38_canonical_json", r"""select event_id, '{"k":' || (props::json->>'k') || ',"tags":["' || lower(event_type) || '",null],"who":{"a":' || user_id || ',"name":"user ' || user_id || '"}}' as canonical from events""")
def canonical(spark, d):
    """Objects with their keys out of order, spaces and capitals, in one form."""
    name = F.concat(F.lit('{"who": {"name": " USER '), F.col("user_id"), F.lit('  ", "a": '), F.col("user_id"), F.lit('}, "tags": [" '), F.upper("event_type"), F.lit('", null], "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, d, "events").select("event_id", canonical_json(name).alias("canonical"))
