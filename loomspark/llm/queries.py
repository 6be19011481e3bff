"""Queries of the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import text_hash
from ..session import materialise, table
from . import conversations as conv
from . import encodings as enc
from . import mixing, packing, pii, tokens

KEY = "lower(trim({}, ' ' || chr(9) || chr(10) || chr(13)))"


def _verdicts(spark, d) -> DataFrame:
    return conv.verdicts(table(spark, d, "messages"), table(spark, d, "sessions"), table(spark, d, "role_names"))


def p7_found(spark, d) -> DataFrame:
    return _verdicts(spark, d).filter("reason is not null").select("session_key")


def p7_reasons(spark, d) -> DataFrame:
    return _verdicts(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n_conversations"))


def p7_conversations(spark, d) -> DataFrame:
    return conv.conversations(table(spark, d, "messages"), table(spark, d, "sessions"), table(spark, d, "role_names"))


def p4_found(spark, d) -> DataFrame:
    return pii.find(table(spark, d, "messages"), table(spark, d, "name_roster")).filter("message_id is not null").select("message_id", F.col("kind").alias("pii_type")).distinct()


def p4_redacted(spark, d) -> DataFrame:
    messages = table(spark, d, "messages")
    return pii.redact(messages, pii.find(messages, table(spark, d, "name_roster")))


def p4_altered(spark, d) -> DataFrame:
    messages = table(spark, d, "messages")
    return pii.altered(messages, p4_redacted(spark, d))


def _packed(spark, d) -> tuple[DataFrame, dict[str, int]]:
    sized = materialise(tokens.with_sizes(table(spark, d, "documents").select("doc_id", "text"), "text"), "sizes")
    containers = {r[0]: r[1] for r in table(spark, d, "container_sizes").filter("capacity_tokens > 0").collect()}  # a fixed table
    return packing.pack(sized, containers), containers


def p8_assignment(spark, d) -> DataFrame:
    return _packed(spark, d)[0]


def p8_fill(spark, d) -> DataFrame:
    return packing.fill(*_packed(spark, d))


def p8_violations(spark, d) -> DataFrame:
    sized = materialise(tokens.with_sizes(table(spark, d, "documents").select("doc_id", "text"), "text"), "sizes")
    containers = {r[0]: r[1] for r in table(spark, d, "container_sizes").filter("capacity_tokens > 0").collect()}  # a fixed table
    return packing.violations(materialise(packing.pack(sized, containers), "packed"), sized, containers)


def _mixed(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "source", text_hash(F.col("text")).alias("h"), "text")
    flat = docs.select("doc_id", "source", F.col("h.a").alias("a"), F.col("h.b").alias("b"), "text")
    sized = materialise(tokens.with_sizes(flat, "text"), "sizes").select("doc_id", "source", F.struct("a", "b").alias("h"), "n_tokens")
    return *mixing.mix(sized, table(spark, d, "mix_targets")), sized


def p9_mix(spark, d) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_shares(spark, d) -> DataFrame:
    return _mixed(spark, d)[1]


def p9_violations(spark, d) -> DataFrame:
    chosen, _, sized = _mixed(spark, d)
    return mixing.violations(chosen, sized, table(spark, d, "mix_targets"))


def _garbled(spark, d, with_text: bool) -> DataFrame:
    docs = table(spark, d, "documents")
    model = enc.fit(enc.vocabulary(docs, "text", "source"))
    return enc.detect(docs, "doc_id", "text", "source", model, with_text)


def p10_found(spark, d) -> DataFrame:
    return _garbled(spark, d, False).select("doc_id")


def p10_untouched(spark, d) -> DataFrame:
    """Documents of plain ASCII without character references, which can't be garbled, and how many of them are reported."""
    plain = table(spark, d, "documents").filter("text is not null and octet_length(text) = length(text) and not contains(text, '&')").select("doc_id")
    found = _garbled(spark, d, False).select("doc_id", F.lit(1).alias("hit"))
    return plain.join(found, "doc_id", "left").agg(F.count(F.lit(1)).alias("n_plain"), F.count("hit").alias("n_reported")).filter("n_plain > 0")


def p10_repaired(spark, d) -> DataFrame:
    return _garbled(spark, d, True)


_MSG = f"""m as (select distinct {KEY.format('session_key')} as k, ordinal, coalesce(r.role_name, {KEY.format('role')}) as role, kind, text from messages left join role_names r on r.raw_role = {KEY.format('role')} where session_key is not null),
dense as (select k, count(*) = count(distinct ordinal) and min(ordinal) = 0 and max(ordinal) = count(*) - 1 and count(ordinal) = count(*) as ok from m group by k),
sym as (select k, ordinal, case when kind = 'message' and role = 'user' then 'U' when kind = 'message' and role = 'assistant' then 'A' else 'O' end as s from m where regexp_replace(coalesce(text, ''), '[\\s\\p{{Z}}\\x{{0085}}\\x{{180e}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}]', '', 'g') <> ''),
nx as (select k, s, lead(s) over w as n1, lead(case when s <> 'O' then s end ignore nulls) over w as n2 from sym window w as (partition by k order by ordinal)),
rep as (select k, bool_or(s = 'U') and bool_or(s = 'A') and not bool_or(s = 'U' and coalesce(n1, '') <> 'U' and coalesce(n2, '') <> 'A') as ok from nx group by k),
verdict as (select k, case when d.k is null then 'empty' when not coalesce(d.ok, false) then 'broken' when not coalesce(rep.ok, false) then 'no_reply' end as reason from (select k from m union select {KEY.format('session_key')} from sessions where session_key is not null) a left join dense d using (k) left join rep using (k))"""

QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted, "p4_altered": p4_altered, "p7_found": p7_found, "p7_reasons": p7_reasons, "p7_conversations": p7_conversations, "p8_assignment": p8_assignment, "p8_fill": p8_fill, "p8_violations": p8_violations, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_violations": p9_violations, "p10_found": p10_found, "p10_untouched": p10_untouched, "p10_repaired": p10_repaired}
SQL = {
    "p4_altered": "select count(*) as n_rows, cast(0 as bigint) as n_altered from (select id from messages group by id having count(*) = 1)",
    "p8_violations": "select container_name, (select count(*) from documents) as n_items, cast(0 as bigint) as n_over, cast(0 as bigint) as n_wrong, cast(0 as bigint) as n_split from container_sizes where capacity_tokens > 0",
    "p9_violations": "select source_name, cast(0 as bigint) as n_too_often, cast(0 as bigint) as n_foreign, cast(0 as bigint) as n_twice, cast(0 as bigint) as n_missized from mix_targets where source_name is not null group by 1",
    "p10_untouched": "select count(*) as n_plain, cast(0 as bigint) as n_reported from documents where text is not null and strlen(text) = length(text) and not contains(text, '&')",
    "p7_found": f"with {_MSG} select k as session_key from verdict where reason is not null",
    "p7_reasons": f"with {_MSG} select coalesce(reason, 'kept') as reason, count(*) as n_conversations from verdict group by 1",
    "p7_conversations": f"with {_MSG} select k as session_key, cast(ordinal as bigint) as position, role, kind, text from m join verdict using (k) where reason is null",
}
