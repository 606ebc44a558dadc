"""Queries over canonical JSON and embedding profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import canonical
from .driver import table
from .registry import query


@query("h7_stable_json", """select event_id, '{"a":{"k":' || k || '},"list":[' || k || ',1.5,{"x":"a \\" b","y":null},[],{}],"z":' || (event_id % 7) || '}' as stable
from (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events)""")
def h7(spark, d):
    """Every event's properties inside a nested value, spelled in one of three ways."""
    e = table(spark, d, "events")
    k, z = F.get_json_object("props", "$.k"), (F.col("event_id") % 7).cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"z": '), z, F.lit('.0, "list": ['), k, F.lit(', 1.50, {"y": null, "x": "a \\" b"}, [ ], { }], "a": '), "props", F.lit("}")))
    text = text.when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"a":'), "props", F.lit(',"z":'), z, F.lit(',"list":['), k, F.lit('e0,1.5,{"x":"a \\u0022 b","y":null},[],{}]}')))
    text = text.otherwise(F.concat(F.lit('\n{ "list" : [ '), k, F.lit(' , 15e-1 , { "x" : "a \\" b" , "y" : null } , [] , {} ] , "z" : '), z, F.lit(' , "a" : '), "props", F.lit(" }")))
    return canonical.stable_json(e.select("event_id", text.alias("j")), "event_id", "j")


_FAMILY = "(['e5','bge','openai','generic'])[i % 4 + 1]"
_PREFIX = "case when i % 4 = 0 and i % 5 <> 1 or i % 5 = 2 then {0} else '' end"


@query("h14_embedding_profile", f"""with r as (select doc_id, doc_id % 40 as i from documents),
p as (select doc_id, i, {_FAMILY} as family, case i % 5 when 1 then 'symmetric' when 2 then 'prefix' else case when i % 4 = 0 then 'prefix' else 'symmetric' end end as role_strategy,
 {_PREFIX.format("case when i % 4 = 0 then 'query: ' else '' end")} as query_prefix, {_PREFIX.format("case when i % 4 = 0 then 'passage: ' else '' end")} as document_prefix, case when i % 3 = 0 then 256 + i end as dimensions, case when i % 8 = 3 then 'l2' else 'auto' end as normalization,
 case when i % 10 = 4 then 500 when i % 10 = 5 then 7 else 60 end as k, case when i % 6 = 1 then '1' when i % 6 = 2 then '0.25' else 'null' end as memory from r)
select doc_id, family, role_strategy, query_prefix, document_prefix, dimensions::bigint as dimensions, normalization, k::bigint as multi_query_rrf_k,
 'es1:' || substr(sha256('{{"dimensions":' || coalesce(dimensions::varchar, 'null') || ',"document_prefix":"' || document_prefix || '","endpoint":"","family":"' || family || '","model":"' || (['org/e5-large','BAAI/bge-m3','text-embedding-3','other-model'])[i % 4 + 1] || '","normalization":"' || normalization || '","provider":"unknown","query_prefix":"' || query_prefix || '","role_strategy":"' || role_strategy || '","version":1}}'), 1, 16) as space_fingerprint,
 'rp1:' || substr(sha256('{{"multi_query_fusion":' || (i % 7 <> 0)::varchar || ',"multi_query_rrf_k":' || k || ',"score_policy":{{"baseline":null,"memory":' || memory || ',"setting":null}},"version":1}}'), 1, 16) as policy_fingerprint from p""")
def h14(spark, d):
    """A configuration by rule for every document, in two spellings."""
    i = F.col("doc_id") % 40
    model = F.element_at(F.array(*[F.lit(m) for m in ("org/e5-large", "BAAI/bge-m3", "text-embedding-3", "other-model")]), (i % 4 + 1).cast("int"))
    said = [
        F.concat(F.lit('"model": "'), model, F.lit('"')), F.when(i % 5 == 1, F.lit('"role_strategy": "Symmetric"')).when(i % 5 == 2, F.lit('"role_strategy": "prefix"')).when(i % 5 == 3, F.lit('"role_strategy": "auto"')),
        F.when(i % 3 == 0, F.concat(F.lit('"dimensions": '), (i + 256).cast("string"))).when(i % 3 == 1, F.lit('"dimensions": -1')), F.when(i % 8 == 3, F.lit('"normalization": "L2"')),
        F.when(i % 10 == 4, F.lit('"multi_query_rrf_k": 9000')).when(i % 10 == 5, F.lit('"multi_query_rrf_k": 7.9')), F.when(i % 7 == 0, F.lit('"multi_query_fusion": false')),
        F.when(i % 6 == 1, F.lit('"score_policy": {"memory": 3}')).when(i % 6 == 2, F.lit('"score_policy": {"setting": null, "memory": 0.250}')),
    ]
    order = F.when(F.col("doc_id") % 2 == 0, F.array_compact(F.array(*said))).otherwise(F.reverse(F.array_compact(F.array(*said))))
    return canonical.embedding_profiles(table(spark, d, "documents").select("doc_id", F.concat(F.lit("{"), F.array_join(order, ", "), F.lit("}")).alias("c")), "doc_id", "c")
