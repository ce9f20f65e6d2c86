"""Secrets in texts, and weak parts of credentials that count only together. DataFrame functions throughout.

Strong spans are reported always. Weak ones (an account name, a random-looking word, an endpoint) are
reported only where the parts that complete a credential stand within a scope of ``SCOPE`` code points: an
interval join by document and cell of that width, in which no cell holds more than a bounded number of parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likegraph.llm.arrays import let, running_greatest, running_totals
from likegraph.llm.shared import written

SCOPE = 200
# Fixed values of the contract: the strong patterns. Runs under the least length are left out of access and hex, as no other match can start inside one.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
# The weak ones.
NAME = r"""(?i)(client_?id|access_?key_?id|key_?id|user_?name|user_?id|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{4,}"""
WORD = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"
ENDPOINT = r"""(?i)(https?|ftp|sftp|ssh|s3|jdbc:[a-z0-9]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]+"""
#: In the order of the joined text.
KINDS = ("assign", "access", "hex", "name", "word", "endpoint")
#: What a kind may be: an identifier, a secret or an endpoint.
IDENTIFIERS, SECRETS = (1, 3), (0, 2, 4)

#: Code points of a piece that a redaction cuts at a time.
_PIECE = 16_384

_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 1, also: tuple[str, ...] = ()) -> Column:
    """Matches of pattern as (start, kind, end): the text is split at them, and what lies between gives their places."""
    p = F.lit(pattern)
    every = lambda group: F.regexp_extract_all(text, p, F.lit(group))
    good = lambda x: reduce(lambda a, r: a & x["v"].rlike(r), also, F.length(x["v"]) >= least)

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, m: (F.length(gap) + F.length(m)).cast("long"))
        both = F.arrays_zip(found.alias("m"), (every(value_group) if value_group else found).alias("v"), running_totals(steps).alias("end"))
        places = F.transform(both, lambda x: F.struct((x["end"] - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["v"].alias("v")))
        return F.transform(F.filter(places, good), lambda x: F.struct(x["start"], x["kind"], x["end"]))

    return F.when(text.rlike(pattern), let(every(0), placed)).otherwise(F.array().cast(_SPAN))


def marked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _strong and _weak spans, each in order of start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    strong = F.concat(_spans(t, ASSIGN, 0, 2, 12), _spans(t, ACCESS, 1), _spans(t, HEX, 2))
    weak = F.concat(_spans(t, NAME, 3), _spans(t, WORD, 4, also=("[0-9]", "[A-Z]", "[a-z]")), _spans(t, ENDPOINT, 5))
    return docs.withColumns({"_strong": F.array_sort(strong), "_weak": F.array_sort(weak)})


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """rows (of marked, with a distinct _rid) with _linked: the weak spans that other parts complete.

    A name needs a secret in scope, a random word an identifier, an endpoint both. A weak span that
    overlaps a strong one adds nothing and goes.
    """
    part = lambda c: rows.select("_rid", F.explode(c).alias("s")).select("_rid", "s.start", "s.end", "s.kind")
    cell = lambda x: F.floor(x / scope)
    weak = part("_weak")
    parts = part("_strong").unionByName(weak)
    w = weak.select("_rid", F.col("start").alias("ws"), F.col("end").alias("we"), F.col("kind").alias("wk"), F.explode(F.sequence(cell(F.col("start") - scope), cell(F.col("end") + scope))).alias("cell"))
    p = parts.select("_rid", "start", "end", "kind", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("cell"))
    near = w.join(p, ["_rid", "cell"]).filter((F.col("start") <= F.col("we") + scope) & (F.col("end") >= F.col("ws") - scope))
    kind = F.col("kind")
    facts = near.groupBy("_rid", "ws", "wk", "we").agg(
        F.max(kind.isin(*IDENTIFIERS)).alias("identifier"), F.max(kind.isin(*SECRETS)).alias("secret"), F.max((kind < 3) & (F.col("start") < F.col("we")) & (F.col("end") > F.col("ws"))).alias("covered")
    )
    keep = facts.filter(~F.col("covered")).filter(F.when(F.col("wk") == 3, F.col("secret")).when(F.col("wk") == 4, F.col("identifier")).otherwise(F.col("identifier") & F.col("secret")))
    found = keep.groupBy("_rid").agg(F.collect_list(F.struct(F.col("ws").alias("start"), F.col("wk").alias("kind"), F.col("we").alias("end"))).alias("_linked"))
    return rows.join(found, "_rid", "left").withColumn("_linked", F.coalesce("_linked", F.array().cast(_SPAN)))


def _with_links(rows: DataFrame, scope: int) -> DataFrame:
    """rows (of marked) with _spans: _strong and the weak ones that are linked. Rows are written once, numbered, so that patterns run once; only those with weak spans take part in the join."""
    held = written(rows.withColumn("_rid", F.monotonically_increasing_id()), "marked")
    none = held.filter(F.size("_weak") == 0).withColumn("_spans", F.col("_strong"))
    some = linked(held.filter(F.size("_weak") > 0), scope).withColumn("_spans", F.array_sort(F.concat("_strong", "_linked")))
    columns = [*(c for c in rows.columns if c != "_weak"), "_spans"]
    return none.select(*columns).unionByName(some.select(*columns))


def find_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with _strong and _spans (all), arrays of (start, kind, end) in code points by start, then kind.

    Null text counts as empty; an empty table gives an empty one. Rows keep their number, whether or not
    ids repeat or are null. Columns of docs must not start with the names used here.
    """
    return _with_links(marked(docs, text), scope)


def said(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: a row for each row of docs, also where ids are null or repeat. Null text counts as empty, and other columns are not read."""
    rows = marked(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text")
    found = _with_links(rows, SCOPE)
    count = lambda k: F.size(F.filter("_strong", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(said(F.col("_strong")).cast("binary"), 256).alias("base_sha256"), said(F.col("_spans")).alias("spans"))


def _cut(text: Column, spans: Column, mark: str) -> Column:
    """text with each run of overlapping spans replaced by mark.

    The text is taken apart into pieces of _PIECE code points first, and each piece is cut by its own spans:
    a cut costs no more than a piece, wherever in the text it is.
    """
    ends = F.transform(spans, lambda s: s["end"])
    reach = lambda e: F.concat(F.array(F.lit(0).cast("long")), running_greatest(e))
    # what each span adds to those before it, and whether it begins a mark
    taken = lambda r: F.filter(
        F.transform(spans, lambda s, i: F.struct(F.greatest(s["start"], F.element_at(r, i + 1)).alias("from"), s["end"].alias("to"), (s["start"] >= F.element_at(r, i + 1)).alias("new"))), lambda c: c["to"] > c["from"]
    )
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))

    def cut(piece: Column, low: Column, own: Column) -> Column:
        until = lambda o, i: F.when(i == 0, low).otherwise(F.greatest(F.element_at(o, F.greatest(i, F.lit(1)))["to"], low))
        kept = lambda o: F.transform(o, lambda c, i: F.concat(F.substring(piece, until(o, i) - low + 1, F.greatest(c["from"] - until(o, i), F.lit(0))), F.when(c["new"] & (c["from"] >= low), F.lit(mark)).otherwise(F.lit(""))))
        tail = lambda o: F.substring(piece, F.element_at(o, -1)["to"] - low + 1, F.lit(_PIECE))
        return F.when(F.size(own) == 0, piece).otherwise(let(own, lambda o: F.concat(F.array_join(kept(o), ""), F.when(F.element_at(o, -1)["to"] < low + _PIECE, tail(o)).otherwise(F.lit("")))))

    def each(all_taken: Column) -> Column:
        low = lambda i: (i * _PIECE).cast("long")
        own = lambda i: F.filter(all_taken, lambda c: (c["to"] > low(i)) & (c["from"] < low(i) + _PIECE))
        return F.array_join(F.transform(pieces, lambda p, i: cut(p, low(i), own(i))), "")

    return let(reach(ends), lambda r: let(taken(r), each))


def redacted(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """docs with each reported span (overlapping ones as one) replaced by mark; n_chars, if there, is counted anew. Null text stays null, columns may have any names, and repeated rows stay as many."""
    found = find_secrets(docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text")), "_text")
    some = F.size("_spans") > 0
    out = found.withColumn("_new", F.when(some, _cut(F.col("_text"), F.col("_spans"), mark)).otherwise(F.col("_text")))
    new = {text: F.col("_new"), "n_chars": F.when(some, F.length("_new").cast("long")).otherwise(F.col("_doc")["n_chars"]) if "n_chars" in docs.columns else None}
    return out.select(*[(new[c] if c in new else F.col("_doc")[c]).alias(c) for c in docs.columns])
