"""Secret scans with multipart credential linking (native DataFrame operations only).

Three base kinds are reported wherever they match. Three weak kinds (identifiers,
mixed tokens, endpoints) are common in harmless texts and are reported only when
complementary parts lie in one scope: parts are joined by intervals, dealt by
(text, stretch of SCOPE code points), so neither a text with many parts nor many
copies of one text meet in one task.

Regular expressions give no positions in SQL; the position of a match is the sum
of the lengths of the stretches between matches and of the matches before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

#: Code points around a weak candidate's start in which its complements count.
SCOPE = 256
#: Elements that are summed at a time for prefix sums within a row.
CHUNK = 256


def _either_case(s: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)


_KEYS = "|".join(_either_case(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
_NAMES = "|".join(_either_case(x) for x in ("client_?id", "access_?key_?id", "account_?id", "user_?name", "login"))
_SET = r"""["']?\x20*[:=]\x20*["']?"""
#: kind -> (pattern, group whose length counts, least length); kinds in the order of equal starts.
BASE = {
    "assign": (f"({_KEYS}){_SET}([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": ("AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),
}
WEAK = {
    "ident": (f"({_NAMES}){_SET}([A-Za-z0-9+/_.@-]+)", 2, 3),
    "mixed": ("[A-Za-z0-9+/_-]{20,}", 0, 20),
    "endpoint": (r"""(https?|s3|jdbc:[a-z]+|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+""", 0, 8),
}
KINDS = [*BASE, *WEAK]
SPAN = "array<struct<start:bigint,k:int,end:bigint>>"


def _matches(df: DataFrame, text: str, kind: str) -> DataFrame:
    """Adds the array column `kind` of spans (start, k, end), in code points."""
    pattern, group, least = (BASE | WEAK)[kind]
    t = F.col(text)
    hit = t.rlike(pattern)
    nil = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(hit, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(nil))
    has = F.size("_m") > 0
    df = df.withColumn("_g", F.when(has, F.regexp_extract_all(t, F.lit(pattern), F.lit(group))).otherwise(nil) if group else F.col("_m"))
    df = df.withColumn("_p", F.when(has, F.split(t, pattern, -1)).otherwise(nil))
    df = df.withColumn("_len", F.transform("_m", lambda m, i: (F.length(m) + F.length(F.get("_p", i))).cast("long")))
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    chunks = F.expr(f"sequence(0, size(_len) div {CHUNK})")
    df = df.withColumn("_sums", F.transform(chunks, lambda c: F.aggregate(F.slice("_len", c * CHUNK + 1, CHUNK), zero, add)))
    df = df.withColumn("_base", F.transform(chunks, lambda c: F.aggregate(F.slice("_sums", 1, c), zero, add)))
    end = lambda i: F.get("_base", F.floor(i / CHUNK).cast("int")) + F.aggregate(F.slice("_len", (F.floor(i / CHUNK) * CHUNK + 1).cast("int"), i % CHUNK + 1), zero, add)
    df = df.withColumn("_end", F.transform("_len", lambda x, i: end(i)))
    ok = lambda g: F.length(g) >= least
    if kind == "mixed":
        ok = lambda g: (F.length(g) >= least) & g.rlike("[0-9]") & g.rlike("[a-z]") & g.rlike("[A-Z]")
    spans = F.transform("_m", lambda m, i: F.when(ok(F.get("_g", i)), F.struct((F.get("_end", i) - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("k"), F.get("_end", i).alias("end"))))
    return df.withColumn(kind, F.filter(spans, lambda s: s.isNotNull()).cast(SPAN)).drop("_m", "_g", "_p", "_len", "_sums", "_base", "_end")


def _joined(spans):
    """Column: `kind:start:end` of sorted spans, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(name, s["k"]), s["start"], s["end"])))


def linked_parts(parts: DataFrame, scope=SCOPE) -> DataFrame:
    """parts: id, th (text hash), start, k, end. The weak ones whose complements lie in scope.

    An identifier needs a secret (assign, hex, mixed); a mixed token needs an identifier
    (access, ident); an endpoint needs both. A mixed token that overlaps a base span is none.
    """
    k = {n: i for i, n in enumerate(KINDS)}
    weak = parts.filter(F.col("k") >= len(BASE)).select("id", "th", "start", "k", "end", F.expr(f"start div {scope}").alias("b")).distinct()
    others = parts.filter(F.col("k") != k["endpoint"]).select(
        F.col("id").alias("i2"), F.col("th").alias("t2"), F.col("start").alias("s2"), F.col("k").alias("k2"), F.col("end").alias("e2"),
        F.explode(F.expr(f"sequence(greatest(start div {scope} - 1, 0), end div {scope} + 1)")).alias("b2"),
    )
    near = weak.join(others, F.col("id").eqNullSafe(F.col("i2")) & (F.col("th") == F.col("t2")) & (F.col("b") == F.col("b2")))
    near = near.filter((F.col("s2") <= F.col("start") + scope) & (F.col("e2") >= F.col("start") - scope))
    over = (F.col("k2") < len(BASE)) & (F.col("s2") < F.col("end")) & (F.col("e2") > F.col("start"))
    flags = near.groupBy("id", "th", "start", "k", "end").agg(
        F.bool_or(over).alias("over"),
        F.bool_or(F.col("k2").isin(k["access"], k["ident"])).alias("ident"),
        F.bool_or(F.col("k2").isin(k["assign"], k["hex"], k["mixed"]) & ~((F.col("k2") == F.col("k")) & (F.col("s2") == F.col("start")))).alias("secret"),
    )
    kind = F.col("k")
    good = F.when(kind == k["ident"], F.col("secret")).when(kind == k["mixed"], F.col("ident") & ~F.col("over")).otherwise(F.col("ident") & F.col("secret"))
    return flags.filter(good).select("id", "th", "start", "k", "end")


def _scan(docs: DataFrame, id_col: str, text_col: str, scope: int) -> DataFrame:
    """The rows of secret_scans() with th, the hash of the text."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        df = _matches(df, "text", kind)
    base = F.concat(*[F.col(x) for x in BASE])
    weak = F.concat(*[F.col(x) for x in WEAK])
    found = stored(df.select("id", F.xxhash64("text").alias("th"), *[F.size(x).cast("long").alias(f"n_{x}") for x in BASE], base.alias("base"), weak.alias("weak")), "secret-spans")
    # rows that repeat an id and text have the same parts: one of them stands for all
    some = found.filter((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)).dropDuplicates(["id", "th"])
    parts = some.select("id", "th", F.explode(F.concat("base", "weak")).alias("s")).select("id", "th", "s.*")
    added = linked_parts(parts, scope).groupBy("id", "th").agg(F.collect_list(F.struct("start", "k", "end")).cast(SPAN).alias("more"))
    added = stored(added.select(F.col("id").alias("i2"), F.col("th").alias("t2"), "more"), "secret-links")
    out = found.join(added, F.col("id").eqNullSafe(F.col("i2")) & (F.col("th") == F.col("t2")), "left")
    return out.select(
        F.col("id").alias("doc_id"), "th", "n_assign", "n_access", "n_hex",
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_linked"),
    )


def secret_scans(docs: DataFrame, id_col="doc_id", text_col="text", scope=SCOPE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Positions count code points, ends are exclusive. A null text is empty: no spans, the
    digest of the empty string. Rows with equal id and text are scanned alike.
    """
    return _scan(docs, id_col, text_col, scope).drop("th")


def redacted(docs: DataFrame, id_col="doc_id", text_col="text", mark="[secret]", scope=SCOPE) -> DataFrame:
    """`docs` with every reported span of the text replaced by `mark`; other columns unchanged.

    Overlapping spans are replaced as one. Rows without spans, and null texts, stay as they are."""
    spans = stored(_scan(docs, id_col, text_col, scope).filter("spans <> ''").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("spans").alias("_spans")).distinct(), "secret-redactions")
    rows = docs.join(spans, docs[id_col].eqNullSafe(spans["_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == spans["_th"]), "left")
    # spans by start; a span's cut begins where the spans before it have ended
    pairs = F.transform(F.split(spans["_spans"], ","), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("a"), F.split(s, ":")[2].cast("int").alias("b")))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        t = docs[text_col]
        fresh = s["a"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["b"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["a"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    cut = F.aggregate(pairs, zero, step, lambda acc: F.concat(acc["out"], F.substring(docs[text_col], acc["at"] + 1, F.length(docs[text_col]))))
    return rows.select(*[(F.when(spans["_spans"].isNull(), docs[c]).otherwise(cut).alias(c) if c == text_col else docs[c]) for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents: base counts and digest, and all spans."""
    return secret_scans(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
