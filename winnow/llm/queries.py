"""The subpackage's queries, with the parameters of production, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, jaccard_join, langid, packing, pseudo_lm, secret_scan, suffix_dedup, toxicity

from .storage import bound_batches, ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, by ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(fold("doc_id", 5) != 0)
    model = toxicity.fit(docs.join(F.broadcast(toxicity.choose(labels)), "doc_id").select("text", "toxic"))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", _SAID), (-1, 1, "assistant", _SAID)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(rows.unionByName(own))).drop("n_tokens", "loss_tokens")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pseudo_lm.score(docs, pseudo_lm.fit(docs))


def language_profiles(docs: DataFrame) -> langid.Profiles:
    return langid.fit(docs.filter(fold("doc_id", 4) != 2))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", "text"), language_profiles(docs)).select("doc_id", held, "lang_pred", "score")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark)
    found = index.ingest(_table(spark, sf_dir, "documents")).drop("row_id")
    index.drop()  # the result does not read it any more
    return found


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("items", "spans")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _op5_sql() -> str:
    arms = []
    for i, (name, pattern, group, least) in enumerate([*secret_scan.KINDS, ("entropy", secret_scan.CANDIDATE, 1, secret_scan.WINDOW)]):
        rx = pattern.replace("'", "''")
        arms.append(f"""
select doc_id, {i} as kind, '{name}' as name, unnest(range(1, len(m) + 1)) as i, p, m, g, {least} as least from (
  select doc_id, string_split_regex(text, '{rx}') as p, regexp_extract_all(text, '{rx}', 0) as m, regexp_extract_all(text, '{rx}', {group}) as g from d where regexp_matches(text, '{rx}'))""")
    classes = " ".join(f"when regexp_matches(s, '{p}') then {secret_scan.limit(b)}" for _, p, b in secret_scan.CLASSES if p)
    allowed = " or ".join(f"regexp_matches(s, '{p}')" for p in secret_scan.ALLOWED)
    term = ", ".join(map(str, secret_scan.TERM))
    w = secret_scan.WINDOW
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
raw as ({" union all ".join(arms)}),
found as (
  select doc_id, kind, name, m[i] as s, least, len(g[i]) as size,
    (coalesce(list_sum(list_transform(p[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0))::bigint as start
  from raw),
windows as (
  select doc_id, start, pos, s[pos + 1:pos + {w}] as win, case {classes} else {secret_scan.limit(secret_scan.CLASSES[-1][2])} end as most
  from (select *, unnest(range(0, len(s) - {w} + 1)) as pos from found where kind = 3 and not ({allowed}))),
hot as (
  select doc_id, start, pos from windows
  where list_sum(list_transform(list_distinct(string_split(win, '')), lambda c: ([{term}])[len(win) - len(replace(win, c, '')) + 1])) <= most),
spans as (
  select doc_id, kind, name, start, start + len(s) as stop from found where kind < 3 and size >= least
  union all
  select doc_id, 3, 'entropy', start + min(pos), start + max(pos) + {w} from hot group by doc_id, start),
every as (
  select doc_id,
    count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    coalesce(string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) filter (kind < 3), '') as base,
    coalesce(string_agg(name || ':' || start || ':' || stop, ',' order by start, kind), '') as spans
  from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join every using (doc_id)
"""


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORDS = r"'[^\x20\x09-\x0D]+'"

OP2_SQL = f"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) as h from (select doc_id, w, unnest(range(0, len(w) - 49)) as i from t where len(w) >= 50)),
hits as (select doc_id, i from (select *, count(*) over (partition by h) as n from windows) where n > 1),
runs as (
  select *, sum(new) over (partition by doc_id order by i) as run
  from (select *, case when i > lag(i) over (partition by doc_id order by i) + 50 then 1 else 0 end as new from hits))
select doc_id, min(i)::bigint as first_word, (max(i) + 50)::bigint as end_word, (max(i) + 50 - min(i))::bigint as n_words from runs group by doc_id, run
"""

OP3_SQL = f"""
with recursive t as (select doc_id, regexp_extract_all({LOWER}, {WORDS}) as w from documents),
s as (select doc_id, case when len(w) = 0 then [] else list_distinct([array_to_string(w[i:i + least(5, len(w)) - 1], ' ') for i in range(1, len(w) - least(5, len(w)) + 2)]) end as sh from t),
u as (select doc_id, unnest(sh) as x from s),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join s p on p.doc_id = a join s q on q.doc_id = b where 100 * n >= 75 * (len(p.sh) + len(q.sh) - n)),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from s union select e.a, r.other from reach r join edges e on e.b = r.doc_id)
select r.doc_id, len(first(own.sh))::bigint as n_shingles, min(r.other) as component_id, count(distinct md5(array_to_string(list_sort(far.sh), chr(10))))::bigint as n_texts
from reach r join s own on own.doc_id = r.doc_id join s far on far.doc_id = r.other group by r.doc_id
"""

_SAID = "</s>[INST] ok [/INST]"
_MARKS = r"'[<\[]\\*/?(s>|INST\])'"
OP4_SQL = f"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}')))
select conv_id::bigint as conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  ({len(chat.BEGIN)} + sum({len(chat.ROLE + chat.TEXT + chat.END)} + length(role) + length(text) + len(regexp_extract_all(role, {_MARKS})) + len(regexp_extract_all(text, {_MARKS}))))::bigint as formatted_chars
from r group by conv_id
"""

OP8_SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id, count(*) over (partition by coalesce(text, '')) as group_size,
  row_number() over (partition by coalesce(text, '') order by doc_id desc) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents
"""

OP9_SQL = rf"""
with b as (select item_id::varchar as item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
wins as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select item, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
d as (select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
sizes as (select distinct n from wins),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from d, sizes)),
hits as (select doc_id, n, i, item from dw join wins using (n, win)),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (doc_id) left join items using (doc_id)
"""


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in (op1_toxicity, op2_suffix_dedup, op3_jaccard_join, op4_chat_format, op5_secret_scan, op6_lm_score, op7_language_id, op8_exact_dedup, op9_decontaminate, op10_best_fit_packing, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op3_jaccard_join": OP3_SQL, "op4_chat_format": OP4_SQL, "op5_secret_scan": _op5_sql(), "op8_exact_dedup": OP8_SQL, "op9_decontaminate": OP9_SQL}
