"""The queries of this subpackage, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likegraph.llm.alignment import align
from likegraph.llm.brown import perplexity
from likegraph.llm.chat import preferences, turns, with_other_answers
from likegraph.llm.digest import fingerprints
from likegraph.llm.hard_negatives import mine
from likegraph.llm.language_id import identify
from likegraph.llm.minhash import near_duplicates
from likegraph.llm.near_vectors import near_vectors
from likegraph.llm.packing import pack_documents
from likegraph.llm.secrets import ACCESS, ASSIGN, ENDPOINT, HEX, KINDS, NAME, SCOPE, WORD, report
from likegraph.llm.shared import table
from likegraph.llm.tiling import contamination
from likegraph.llm.token_files import read_token_files, write_token_files
from likegraph.llm.toxicity import rate


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from four of five folds. Odd rows: see the operator."""
    return identify(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens. Odd rows: see the operator."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op3_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, written to files of packed words and read back from them. Odd rows: see the operator."""
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op4_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as chosen, and as rejected with the next one's last answer."""
    convs = turns(table(spark, sf_dir, "conversations"))
    out = preferences(convs, with_other_answers(convs))
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["from"].cast("string"), F.lit("-"), s["to"].cast("string"))), ",").alias(c)
    return out.select("conv_id", "n_common", "prompt", "chosen", mask("chosen_mask"), "rejected", mask("rejected_mask"))


OP4_SQL = r"""
with convs as (
  select conv_id, list({'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn, coalesce(role, ''), coalesce(text, '')) t
  from conversations group by conv_id),
known as (select conv_id, t, list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant')) k from convs),
paired as (
  select a.conv_id, a.t c, list_transform(range(1, len(a.t) + 1), lambda i: {'turn': a.t[i].turn, 'role': a.t[i].role, 'text': case when i = a.k then coalesce(b.t[b.k].text, '') else a.t[i].text end}) r
  from known a left join known b on b.conv_id = a.conv_id + 1 and b.k is not null),
cut as (select conv_id, c, r, coalesce(list_min(list_filter(range(1, len(c) + 1), lambda i: c[i].text <> r[i].text)) - 1, len(c)) n from paired),
said as (
  select conv_id, n, list_transform(c, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) cs,
    list_transform(r, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) rs, c, r from cut),
ends as (
  select *, list_transform(range(1, len(c) + 1), lambda i: coalesce(list_sum(list_transform(cs[n+1:i], lambda x: length(x))), 0)) ce,
    list_transform(range(1, len(r) + 1), lambda i: coalesce(list_sum(list_transform(rs[n+1:i], lambda x: length(x))), 0)) re from said)
select conv_id, cast(n as int) n_common, array_to_string(cs[1:n], '') prompt, array_to_string(cs[n+1:], '') chosen,
  array_to_string(list_transform(list_filter(range(n + 1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i: cast(ce[i] - 11 - length(c[i].text) as bigint) || '-' || cast(ce[i] - 1 as bigint)), ',') chosen_mask,
  array_to_string(rs[n+1:], '') rejected,
  array_to_string(list_transform(list_filter(range(n + 1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i: cast(re[i] - 11 - length(r[i].text) as bigint) || '-' || cast(re[i] - 1 as bigint)), ',') rejected_mask
from ends
"""


def op5_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the weak parts that complete a credential. Odd rows: see the operator."""
    return report(table(spark, sf_dir, "documents"))


def _op5_kind(name: str, pattern: str, group: int = 0, least: int = 1, also: str = "true") -> str:
    """A select of the spans of one kind; RE2 has no look-behind, and these patterns need none as they take whole runs."""
    p = re.sub(r"^\(\?<![^)]*\)", "", pattern).replace("'", "''")
    return f"""
select doc_id, {KINDS.index(name)} kind, cast(e - length(m[i]) as bigint) s, cast(e as bigint) e from (
  select doc_id, m, v, unnest(range(1, len(m) + 1)) i, list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) e
  from (select doc_id, regexp_extract_all(t, '{p}', 0) m, regexp_extract_all(t, '{p}', {group}) v, string_split_regex(t, '{p}') g from d where regexp_matches(t, '{p}')))
where length(v[i]) >= {least} and {also.replace("$", "v[i]")}"""


OP5_SQL = f"""
with d as (select doc_id, coalesce(text, '') t from documents),
strong as ({_op5_kind("assign", ASSIGN, 2, 12)} union all {_op5_kind("access", ACCESS)} union all {_op5_kind("hex", HEX)}),
weak as ({_op5_kind("name", NAME)} union all {_op5_kind("word", WORD, also="regexp_matches($, '[0-9]') and regexp_matches($, '[A-Z]') and regexp_matches($, '[a-z]')")} union all {_op5_kind("endpoint", ENDPOINT)}),
facts as (
  select w.doc_id, w.kind, w.s, w.e, bool_or(p.kind in (1, 3)) i, bool_or(p.kind in (0, 2, 4)) c, bool_or(p.kind < 3 and p.s < w.e and p.e > w.s) covered
  from weak w join (from strong union all from weak) p on p.doc_id = w.doc_id and p.s <= w.e + {SCOPE} and p.e >= w.s - {SCOPE} group by all),
spans as (from strong union all select doc_id, kind, s, e from facts where not covered and case kind when 3 then c when 4 then i else i and c end),
told as (
  select doc_id, count(*) filter (kind = 0) a, count(*) filter (kind = 1) k, count(*) filter (kind = 2) h,
    coalesce(string_agg(said, ',' order by s, kind) filter (kind < 3), '') base, string_agg(said, ',' order by s, kind) every
  from (select *, ['assign', 'access', 'hex', 'name', 'word', 'endpoint'][kind + 1] || ':' || s || ':' || e said from spans) group by doc_id)
select doc_id, coalesce(a, 0) n_assign, coalesce(k, 0) n_access, coalesce(h, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(every, '') spans
from d left join told using (doc_id)
"""


def op6_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest, that of its edited text, and how alike they and the next document's are. Odd rows: see the operator."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents of similarity 0.8 or more by two-word shingles. Odd rows: see the operator."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, num=80, den=100)


OP7_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sets as (select doc_id, case when len(w) < 2 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end s from w),
sh as (select doc_id, len(s) n, unnest(s) g from sets),
pairs as (
  select a.doc_id a, b.doc_id b, any_value(a.n) na, any_value(b.n) nb, count(*) c
  from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
half as (select a, b from pairs where 100 * c >= 80 * (na + nb - c)),
links as (select a, b from half union all select b, a from half),
reach as (select doc_id a, doc_id b from documents union select reach.a, links.b from reach join links on links.a = reach.b)
select doc_id, cast(len(s) as bigint) n_shingles, component_id, doc_id = component_id kept
from sets join (select a doc_id, min(b) component_id from reach group by 1) using (doc_id)
"""


def op8_brown_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability under class n-grams of four of five folds. Odd rows: see the operator."""
    return perplexity(table(spark, sf_dir, "documents"))


def op9_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's coverage of benchmark items, and whether that contaminates it. Odd rows: see the operator."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from three of four folds. Odd rows: see the operator."""
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups of tokens of two vocabularies, and how often its linked ids are linked in all documents. Odd rows: see the operator."""
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links with others of its label at a cosine of 0.93 or more. Odd rows: see the operator."""
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


OP12_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) e from embeddings
  where label is not null and coalesce(len(embedding), 0) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select vec_id a, vec_id b from embeddings union select reach.a, links.b from reach join links on links.a = reach.b)
select vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept
from (select a vec_id, min(b) component_id from reach group by 1) left join (select a vec_id, count(*) n from links group by 1) using (vec_id)
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, where each seventh has the label after its own. Odd rows: see the operator."""
    rows = table(spark, sf_dir, "embeddings")
    return mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


OP13_SQL = """
with v as (
  select vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * cast(x as double))) q from embeddings
  where vec_id is not null and label is not null and coalesce(len(embedding), 0) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pair as (select a.id a, b.id b, a.l = b.l same, cast(list_inner_product(a.q, b.q) as bigint) s from v a join v b on a.id % 100 = 0 and a.id <> b.id and len(a.q) = len(b.q)),
pos as (select a, b p, s ps from pair where same qualify row_number() over (partition by a order by s desc, b) <= 5)
select a anchor_id, p positive_id, cast(row_number() over (partition by a, p order by s desc, b) as int) as rank, b negative_id, ps positive_score, s negative_score
from pos join pair using (a) where not same and 30 * ps <= 100 * s and 100 * s <= 90 * ps qualify row_number() over (partition by a, p order by s desc, b) <= 10
"""


QUERIES = {
    "op1_language_mixture": op1_language_mixture,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_simple8b_files": op3_simple8b_files,
    "op4_preference_formatting": op4_preference_formatting,
    "op5_secret_links": op5_secret_links,
    "op6_quartile_digest": op6_quartile_digest,
    "op7_minhash_bayes": op7_minhash_bayes,
    "op8_brown_class_ngrams": op8_brown_class_ngrams,
    "op9_string_tiling": op9_string_tiling,
    "op10_pu_toxicity": op10_pu_toxicity,
    "op11_token_alignment": op11_token_alignment,
    "op12_rotation_codes": op12_rotation_codes,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL = {"op4_preference_formatting": OP4_SQL, "op5_secret_links": OP5_SQL, "op7_minhash_bayes": OP7_SQL, "op12_rotation_codes": OP12_SQL, "op13_hard_negatives": OP13_SQL}
