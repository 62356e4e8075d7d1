"""Personal data by patterns, and by contexts that are learnt from what the patterns find.

The base finds e-mail addresses, IP addresses, card and phone numbers. These, and keys of ``SECRET``'s form, are the seeds of a
bootstrap. Instances are all seeds and all other runs of ``[A-Za-z0-9@._+-]`` with six characters and three digits at least, of any
length, between their first and last letter or digit. The words around an instance are lexical patterns, of one or two words to the
left, with a wild card in place of the nearest, on both sides, or the label that an instance is glued to (``id=...``). Patterns and
instances form a bipartite graph. A pattern is scored by the share of its occurrences whose instances are believed, where its
occurrences are at least those of the rarest of its words in the whole corpus, so that common words are no evidence. A pattern with a
high score and enough different believed instances is trusted, what it extracts is believed and counts for further patterns, until no
pattern is added. Contexts look at ``REACH`` code points to either side; only DataFrame functions are used.

Regular expressions don't backtrack over what they have read (possessive, and a start within a run is only tried after a match), so
that long runs of digits or letters cost no more than others; they match the same texts as the plain forms. Places are running sums
of the lengths of matches and of what is between them, taken in blocks of ``STEP``, so that a text's cost follows its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, few, set_apart

KINDS = ("email", "ip", "card", "phone", "context")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A run with a digit, with marks before and after it that are not part of the instance.
RUN = r"(?<![A-Za-z0-9@._+-])[A-Za-z@._+-]*+[0-9][A-Za-z0-9@._+-]*+"
#: Instances of this form are seeds too, but only spans where a context says so.
SECRET = r"^(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$"
CONFIDENCE, SUPPORT, REACH, STEP = 0.5, 3, 80, 512
ONE = 1_000_000  #: belief and scores are whole millionths: sums of them don't depend on order

_FOUND = "array<struct<start:int,rank:int,end:int,value:string,left:string,right:string>>"
_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _call(name: str, *args: Column) -> Column:
    return F.call_function(name, *args)


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _with(value: Column, use) -> Column:
    """use(value), where value is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, zero: int, merge) -> Column:
    """For each of the whole numbers what ``merge`` has made of those before it, beginning with zero.

    Only numbers are held between steps, and in blocks, as each step copies what is held.
    """
    empty = _none("array<int>")

    def block(a: Column, own: Column) -> Column:
        start = F.struct(a["last"].alias("last"), empty.alias("out"))
        inner = F.aggregate(own, start, lambda b, v: F.struct(merge(b["last"], v).alias("last"), F.concat(b["out"], F.array(b["last"])).alias("out")))
        return F.aggregate(F.array(inner), a, lambda b, i: F.struct(i["last"].alias("last"), F.concat(b["out"], F.array(i["out"])).alias("out")))

    def run(x: Column) -> Column:
        start = F.struct(F.lit(zero).alias("last"), _none("array<array<int>>").alias("out"))
        return F.flatten(F.aggregate(_blocks(x), start, lambda a, b: block(a, F.slice(x, b * STEP + 1, F.lit(STEP))))["out"])

    return _with(values, lambda x: F.when(F.size(x) == 0, empty).otherwise(run(x)))


def _blocks(x: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STEP).cast("int"))


def _placed(text: Column, rank: int, pattern: str) -> Column:
    """Spans of all matches, with what stands to the left and right of each within REACH."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _call("split", text, F.lit(pattern), F.lit(-1))
    some, end = lambda x: F.left(x, F.lit(REACH)), lambda x: _call("right", x, F.lit(REACH))
    many = F.lit(2**31 - 1)

    def sized(b: Column) -> Column:
        lengths = F.zip_with(F.slice(b["gaps"], F.lit(1), F.size(b["found"])), b["found"], lambda g, x: F.length(g) + F.length(x))
        return F.arrays_zip(
            b["found"].alias("found"), _running(lengths, 0, lambda at, n: at + n).alias("at"), b["gaps"].alias("before"), F.slice(b["gaps"], F.lit(2), many).alias("after"),
            F.concat(F.array(F.lit("")), b["found"]).alias("last"), F.slice(b["found"], F.lit(2), many).alias("next"),
        )

    def one(x: Column) -> Column:
        start = x["at"] + F.length(x["before"])
        left, right = end(F.concat(end(x["last"]), end(x["before"]))), some(F.concat(some(x["after"]), some(F.coalesce(x["next"], F.lit("")))))
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x["found"])).alias("end"), x["found"].alias("value"), left.alias("left"), right.alias("right"))

    zipped = _with(F.struct(found.alias("found"), gaps.alias("gaps")), sized)
    return F.transform(F.filter(zipped, lambda x: x["found"].isNotNull()), one)


def _of(text: Column, rank: int, pattern: str, guard: Column, valid=None) -> Column:
    spans = F.when(guard & text.rlike(pattern), _placed(text, rank, pattern)).otherwise(_none(_FOUND))
    return spans if valid is None else F.filter(spans, lambda s: valid(s["value"]))


def _small_parts(x: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(x, "\\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))


def _luhn(x: Column) -> Column:
    digits = F.reverse(F.translate(x, " -", ""))
    doubled = lambda d: _call("substring", F.lit("0246813579"), d + 1, F.lit(1)).cast("int")
    digit = lambda i: _call("substring", digits, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, digit(i)).otherwise(doubled(digit(i))))
    return F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(False)


def _phone_digits(x: Column) -> Column:
    return F.length(F.translate(x, "+ ().-", "")).between(10, 15)


def _base(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    return {
        "email": _of(text, 0, EMAIL, text.contains("@")), "ip": _of(text, 1, IP, digit & text.contains("."), _small_parts),
        "card": _of(text, 2, CARD, digit, _luhn), "phone": _of(text, 3, PHONE, text.contains("+"), _phone_digits),
    }


def _instances(text: Column) -> Column:
    """Runs that may identify someone or something: trimmed, of six characters and three digits at least."""
    runs = _of(text, 4, RUN, text.rlike("[0-9]"))

    def trimmed(s: Column) -> Column:
        first = F.length(F.regexp_extract(s["value"], "^[^A-Za-z0-9]*", 0))
        value = F.regexp_replace(s["value"], "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
        last = F.length(s["value"]) - first - F.length(value)
        return F.struct(
            (s["start"] + first).alias("start"), s["rank"].alias("rank"), (s["end"] - last).alias("end"), value.alias("value"),
            _call("right", F.concat(s["left"], F.left(s["value"], first)), F.lit(REACH)).alias("left"), F.left(F.concat(_call("right", s["value"], last), s["right"]), F.lit(REACH)).alias("right"),
        )

    return F.filter(F.transform(runs, trimmed), lambda s: (F.length(s["value"]) >= 6) & (F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= 3))


def _free(base: Column, other: Column) -> Column:
    """base and those of other that overlap none of it, in order."""
    far = 2**31 - 1
    of_base = lambda s, value, none: F.when(s["rank"] < 4, value).otherwise(F.lit(none))

    def run(x: Column) -> Column:
        end = _running(F.transform(x, lambda s: of_base(s, s["end"], 0)), 0, F.greatest)
        after = F.reverse(_running(F.reverse(F.transform(x, lambda s: of_base(s, s["start"], far))), far, F.least))
        zipped = F.arrays_zip(x.alias("s"), end.alias("end"), after.alias("after"))
        return F.transform(F.filter(zipped, lambda z: (z["s"]["rank"] < 4) | (z["s"]["start"] >= z["end"]) & (z["s"]["end"] <= z["after"])), lambda z: z["s"])

    both = F.sort_array(F.concat(base, other))
    return F.when((F.size(base) == 0) | (F.size(other) == 0), both).otherwise(_with(both, run))


def _contexts(left: Column, right: Column) -> Column:
    """Patterns of an instance: a letter for the kind, then words, in lower case and with 0 for digits, all apart by a space."""

    def of(b: Column) -> Column:
        glued, near, far, closed, right = (b[c] for c in ("glued", "near", "far", "closed", "right"))
        some = lambda known, kind, *words: F.when(known, F.concat_ws(" ", F.lit(kind), *words))
        return F.array_compact(F.array(
            some(glued.rlike(r"\p{L}.*[^\p{L}\p{N}]"), "g", glued), some(near != "", "1", near, glued), some(far != "", "2", far, near, glued), some(far != "", "*", far, glued),
            some((near != "") & (right != ""), "t", near, right, glued, closed),
        ))

    def words(b: Column) -> Column:
        at = lambda c, i: F.coalesce(F.try_element_at(b[c], F.lit(i)), F.lit(""))
        return F.struct(at("l", -1).alias("glued"), at("l", -2).alias("near"), at("l", -3).alias("far"), at("r", 1).alias("closed"), at("r", 2).alias("right"))

    apart = lambda c: _call("split", F.lower(F.translate(c, "123456789", "000000000")), F.lit(r"\s+"), F.lit(-1))
    return _with(_with(F.struct(apart(left).alias("l"), apart(right).alias("r")), words), of)


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_email, n_ip, n_card, n_phone, base, seen): spans of the base in order, and all instances with their contexts.

    mark is a hash of the text: with doc_id it names a row, whose copies have the same spans.
    """
    text = F.col("_text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    kinds = rows.select("doc_id", F.xxhash64("_text").alias("mark"), *(c.alias(k) for k, c in _base(text).items()), _instances(text).alias("other"))
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    base = kinds.select("doc_id", "mark", *sizes, F.sort_array(F.concat(*KINDS[:4])).alias("base"), "other")
    whole = base.select("doc_id", "mark", *(f"n_{k}" for k in KINDS[:4]), "base", _free(F.col("base"), F.col("other")).alias("seen"))

    def placed(s: Column) -> Column:
        seed = (s["rank"] < 4) | s["value"].rlike(SECRET)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("value"), (s["rank"] < 4).alias("base"), seed.alias("seed"), _contexts(s["left"], s["right"]).alias("contexts"))

    spans = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return whole.select("doc_id", "mark", *(f"n_{k}" for k in KINDS[:4]), spans.alias("base"), F.transform("seen", placed).alias("seen"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word is in all texts, as contexts write it; tasks count before the shuffle."""
    words = F.split(F.lower(F.translate("text", "123456789", "000000000")), r"\s+")
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def learnt_contexts(occurrences: DataFrame, words: DataFrame) -> DataFrame:
    """The trusted patterns (context, score) of occurrences (context, value, seed), in corpora with these counts of words.

    What can't be trusted whatever is believed, for want of different instances or as its words are too common, is left out first. A
    pattern once trusted stays so, hence rounds end; the last adds none.
    """
    edges = cut(few(occurrences.groupBy("context", "value").agg(F.count("*").alias("w"), F.max("seed").alias("seed"))))
    many = cut(few(edges.groupBy("context").agg(F.count("*").alias("values"), F.sum("w").alias("w")).where(F.col("values") >= SUPPORT).select("context", "w")))
    parts = F.split("context", " ")
    anchors = F.when(F.col("context").rlike("^[2t]"), F.slice(parts, 2, 2)).when(F.col("context").rlike("^g"), _none("array<string>")).otherwise(F.slice(parts, 2, 1))
    rarest = many.select("context", F.explode(anchors).alias("word")).join(words, "word").groupBy("context").agg(F.min("n").alias("n"))
    per = many.join(rarest, "context", "left").select("context", (F.greatest("w", F.coalesce("n", F.lit(0))) + 1).alias("of"), "w")
    per = cut(few(per.where(F.col("w") >= CONFIDENCE * F.col("of")).drop("w")))
    live = cut(few(edges.join(per, "context")))
    belief = live.where("seed").select("value").distinct().withColumn("belief", F.lit(ONE).cast("long"))
    trusted, before = None, 0
    while True:
        known = live.join(belief, "value", "left").groupBy("context", "of").agg(F.sum(F.col("w") * F.coalesce("belief", F.lit(0))).alias("sum"), F.count("belief").alias("support"))
        known = known.withColumn("score", F.floor(F.col("sum") / F.col("of")))
        trusted = cut(few(known.where((F.col("support") >= SUPPORT) & (F.col("score") >= CONFIDENCE * ONE)).select("context", "score")))
        if (n := trusted.count()) == before:
            return trusted
        before = n
        said = live.join(trusted, "context", "left").groupBy("value").agg(F.max(F.when(F.col("seed"), F.lit(ONE).cast("long")).otherwise(F.col("score"))).alias("belief"))
        belief = cut(few(said.where("belief is not null")))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_email, n_ip, n_card, n_phone, base, more): spans (start, rank, end) of the base, and those that contexts add.

    Null texts count as empty. Rows without doc_id, with the same doc_id, and repeated rows stay and have their own spans.
    """
    rows = cut(scanned(docs))
    seen = rows.select("doc_id", "mark", F.explode("seen").alias("s")).select("doc_id", "mark", "s.*")
    each = seen.select("doc_id", "mark", "start", "end", "value", "base", "seed", F.explode("contexts").alias("context"))
    good = learnt_contexts(each, word_counts(docs)).select("context")
    new = each.where("not base").join(good, "context").select("doc_id", "mark", "start", "end").distinct()
    new = new.groupBy(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).agg(F.sort_array(F.collect_list(F.struct("start", F.lit(4).alias("rank"), "end"))).alias("more"))
    at = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    return rows.drop("seen").join(new, at, "left").select(*(c for c in rows.columns if c != "seen"), F.coalesce("more", _none(_SPANS)).alias("more"))


def _written(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and n_context, the number of spans that contexts add, for every row of docs.

    Null and empty texts have no spans; repeated rows, and rows without doc_id, each have their own result.
    """
    found = spans(docs)
    counts = [f"n_{k}" for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.sort_array(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_context"))


def _replaced(text: Column, spans: Column) -> Column:
    """text with ``[KIND]`` in place of each span. Blocks of spans take their part of the text first, so that no span walks the whole text."""
    kind = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def block(own: Column) -> Column:
        zero = F.element_at(own, 1)["at"]
        part = _call("substring", text, zero + 1, F.greatest(F.element_at(own, -1)["s"]["start"] - zero, F.lit(0)))  # spans are in order of starts

        def pieces(b: Column) -> Column:
            gap = lambda z: _call("substring", b["part"], z["at"] - b["zero"] + 1, z["s"]["start"] - z["at"])
            return F.array_join(F.transform(b["own"], lambda z: F.when(z["s"]["start"] >= z["at"], F.concat(gap(z), F.get(kind, z["s"]["rank"]))).otherwise("")), "")

        return _with(F.struct(own.alias("own"), zero.alias("zero"), part.alias("part")), pieces)

    def run(x: Column) -> Column:
        at = _running(F.transform(x, lambda s: s["end"]), 0, F.greatest)
        last = _call("substring", text, F.array_max(F.transform(x, lambda s: s["end"])) + 1)
        joined = lambda z: F.array_join(F.transform(_blocks(z), lambda b: _with(F.slice(z, b * STEP + 1, F.lit(STEP)), block)), "")
        return F.concat(_with(F.arrays_zip(x.alias("s"), at.alias("at")), joined), last)

    return _with(spans, lambda x: F.when(F.size(x) == 0, text).otherwise(run(x)))


def redacted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any other columns) with ``[KIND]`` in place of each span; of spans that overlap the first names the kind.

    Null texts stay null, repeated rows stay.
    """
    found = spans(docs).where("size(base) + size(more) > 0").select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.sort_array(F.concat("base", "more")).alias("_spans")).dropDuplicates(["_doc", "_mark"])
    own, back = set_apart(docs, "doc_id", "text")
    joined = own.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_mark")), "left")
    return back(joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(_replaced(F.col("text"), F.col("_spans")))))
