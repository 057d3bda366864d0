"""The inverted index, written once and read by every search, and ranked search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidora.functions.match import parse
from evidora.functions.text import index_tokens
from evidora.sources.files import exists, mark, once_written, shared_folder
from evidora.sources.tables import table

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
PUSHED_TERMS = 10_000


def once(passages: DataFrame) -> DataFrame:
    """Passages without repeated rows, by passage_seq."""
    return passages.dropDuplicates(["passage_seq"])


def lengths(passages: DataFrame, key: str = "passage_seq", text: str = "text") -> DataFrame:
    return passages.select(key, F.coalesce(F.size(index_tokens(F.col(text))), F.lit(0)).alias("dl"))


def write_index(passages: DataFrame, docs: DataFrame, folder: str) -> None:
    """Writes an index to a folder, in one pass over the texts:

    - ``postings`` (term, passage_seq, dl, positions), sorted by term in each
      file, a frequent term being spread over up to 16 files;
    - ``places`` (passage_seq, passage_id, doc_id, ord, dl), without texts;
    - ``terms`` (term, df, cf), ``titles`` (term, n_docs), ``meta`` (n, avgdl).

    Repeated rows of a passage_seq count once. Null texts have a place of length 0.
    """
    spark = passages.sparkSession
    tokens = index_tokens(F.col("text"))
    dl = F.coalesce(F.size(tokens), F.lit(0)).alias("dl")
    spread = F.pmod(F.xxhash64("passage_seq"), F.lit(16)).alias("spread")
    # The first generator keeps the text from being split again for each word.
    split = passages.select("passage_seq", spread, F.explode(F.array(F.struct(dl, tokens.alias("tokens")))).alias("s"))
    found = split.select("passage_seq", "spread", "s.dl", F.posexplode("s.tokens").alias("position", "term")).repartition("term", "spread")
    post = found.groupBy("term", "spread", "passage_seq", "dl").agg(F.array_sort(F.collect_set("position")).alias("positions"))
    post.drop("spread").sortWithinPartitions("term", "passage_seq").write.option("parquet.block.size", 16 << 20).parquet(f"{folder}/postings")
    passages.select("passage_seq", "passage_id", "doc_id", "ord", dl).distinct().write.parquet(f"{folder}/places")
    spark.read.parquet(f"{folder}/postings").groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("cf")).write.parquet(f"{folder}/terms")
    words = docs.select("doc_id", F.explode(F.array_distinct(index_tokens(F.col("title")))).alias("term")).distinct()
    words.where(F.length("term") >= 3).groupBy("term").agg(F.count("*").alias("n_docs")).write.parquet(f"{folder}/titles")
    spark.read.parquet(f"{folder}/places").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.parquet(f"{folder}/meta")


class Index:
    """A written index. Opening one that isn't there raises."""

    def __init__(self, spark: SparkSession, folder: str):
        if not exists(spark, f"{folder}/meta/_SUCCESS"):
            raise FileNotFoundError(f"no index at {folder}")
        self.spark, self.folder = spark, folder
        self.n, self.avgdl = spark.read.parquet(f"{folder}/meta").first()

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @property
    def places(self) -> DataFrame:
        return self._table("places")

    @property
    def terms(self) -> DataFrame:
        return self._table("terms")

    @property
    def titles(self) -> DataFrame:
        return self._table("titles")

    def postings(self, terms: list[str]) -> DataFrame:
        """The postings of a query set's terms; a list of up to
        :data:`PUSHED_TERMS` reaches the scan as a filter on the sorted column."""
        post, wanted = self._table("postings"), sorted(set(terms))
        if len(wanted) <= PUSHED_TERMS:
            return post.where(F.col("term").isin(wanted))
        return post.join(self.spark.createDataFrame([(t,) for t in wanted], "term string"), "term", "left_semi")


def open_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the tables at ``sf_dir``; written if there is none of their
    present files."""
    name = mark(spark, f"{sf_dir}/passages.parquet") + mark(spark, f"{sf_dir}/docs.parquet")
    folder = once_written(spark, f"{shared_folder(spark)}/{name}", lambda beside: write_index(table(spark, sf_dir, "passages"), table(spark, sf_dir, "docs"), beside))
    return Index(spark, folder)


def idf(n: int, df: Column) -> Column:
    return F.greatest(F.log((F.lit(n) - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def saturation(avgdl: float, tf: Column, dl: Column) -> Column:
    """What ``tf`` occurrences in a passage of length ``dl`` count."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl or 1.0)))


def bm25(index: Index, queries: DataFrame, query: str) -> DataFrame:
    """Scores (query, passage_seq, score, hits) of every passage that holds a
    term of a query; ``queries`` has rows (query, term), a repeated term counts
    again. The terms of a query set are a stated set, taken to the driver."""
    asked = [r[0] for r in queries.select("term").distinct().collect()]
    weight = queries.join(index.terms.where(F.col("term").isin(asked)) if len(asked) <= PUSHED_TERMS else index.terms, "term").select(query, "term", idf(index.n, F.col("df")).alias("idf"))
    hit = index.postings(asked).select("term", "passage_seq", "dl", F.size("positions").alias("tf")).join(weight, "term")
    score = F.col("idf") * saturation(index.avgdl, F.col("tf"), F.col("dl"))
    return hit.groupBy(query, "passage_seq").agg(F.sum(score).alias("score"), F.count_distinct("term").alias("hits"))


def top(scores: DataFrame, query: str, limit: int, key: str = "passage_seq") -> DataFrame:
    """The first ``limit`` of each query by score, ties in key order, with
    ``rank`` from 1. Each task keeps its first ones before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _units(tree: tuple, units: list[tuple]) -> tuple:
    """A tree whose leaves are numbers of ``units``: (tokens, near group, reach)."""
    if tree[0] == "phrase":
        units.append((tree[1], None, None))
        return ("unit", len(units) - 1)
    if tree[0] == "near":
        first = len(units)
        units += [(p, first, tree[2]) for p in tree[1]]
        return ("all", list(range(first, len(units))))
    return (tree[0], _units(tree[1], units), _units(tree[2], units))


def _clauses(tree: tuple) -> list[set[int]] | None:
    """A tree as clauses of which each needs one of its units; None for trees
    with NOT, or with AND under OR."""
    kind = tree[0]
    if kind == "unit":
        return [{tree[1]}]
    if kind == "all":
        return [{u} for u in tree[1]]
    left, right = (_clauses(t) for t in tree[1:]) if kind != "not" else (None, None)
    if left is None or right is None:
        return None
    if kind == "and":
        return left + right
    return [left[0] | right[0]] if len(left) == len(right) == 1 else None


def _holds(tree: tuple, present: Column) -> Column:
    kind = tree[0]
    if kind == "unit":
        return F.array_contains(present, tree[1])
    if kind == "all":
        out = F.lit(True)
        for u in tree[1]:
            out = out & F.array_contains(present, u)
        return out
    left, right = _holds(tree[1], present), _holds(tree[2], present)
    return left | right if kind == "or" else left & ~right if kind == "not" else left & right


def _counted(tree: tuple, present: Column, here: Column) -> list[tuple[int, Column]]:
    """(unit, whether it counts) of a tree's units: a unit counts where the
    parts of the expression that it stands in are met."""
    kind = tree[0]
    if kind in ("unit", "all"):
        return [(u, here) for u in ([tree[1]] if kind == "unit" else tree[1])]
    if kind == "or":
        return [x for t in tree[1:] for x in _counted(t, present, here & _holds(t, present))]
    met = here & _holds(tree, present)
    return [x for t in (tree[1:2] if kind == "not" else tree[1:]) for x in _counted(t, present, met)]


def match_search(index: Index, expressions: list[tuple[str, str]]) -> DataFrame:
    """(query, passage_seq, score): the passages that satisfy each named MATCH
    expression, with its BM25 score. A quoted phrase is one unit with its own
    tf and df; every unit that a passage holds in a part of the expression that
    it satisfies counts, a repeated one again. Of phrases in NEAR only the
    occurrences near each other count. A malformed expression raises, and an
    expression without any indexed word matches nothing.
    """
    spark, trees, rows, seen = index.spark, {}, [], {}
    for name, expression in expressions:
        units: list[tuple] = []
        tree = _units(parse(expression), units)
        clauses = _clauses(tree)
        if clauses is None:
            trees[name] = tree
        for u, (tokens, group, reach) in enumerate(units):
            seen[tokens] = seen.get(tokens, len(seen))
            rows.append((name, u, seen[tokens], group, reach, len(tokens), [c for c, us in enumerate(clauses or ()) if u in us], None if clauses is None else len(clauses)))
    asked = spark.createDataFrame(rows, "query string, unit int, phrase int, near int, reach int, words int, clauses array<int>, n_clauses int")
    parts = spark.createDataFrame([(k, o, t, len(tokens)) for tokens, k in seen.items() for o, t in enumerate(tokens)], "phrase int, offset int, term string, words int")
    post = index.postings([t for tokens in seen for t in tokens]).join(F.broadcast(parts) if len(seen) <= PUSHED_TERMS else parts, "term")
    single = post.where("words = 1").select("phrase", "passage_seq", "dl", F.col("positions").alias("starts"))
    many = post.where("words > 1").select("phrase", "passage_seq", "dl", "words", F.explode(F.transform("positions", lambda p: p - F.col("offset"))).alias("start"))
    many = many.groupBy("phrase", "passage_seq", "dl", "start").agg(F.count("*").alias("n"), F.first("words").alias("words")).where("n = words").groupBy("phrase", "passage_seq", "dl").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    found = single.unionByName(many)
    weight = found.groupBy("phrase").agg(F.count("*").alias("df"))
    asked = asked.join(weight, "phrase").withColumn("idf", idf(index.n, F.col("df")))
    hits = found.join(asked, "phrase")
    plain = hits.where("near is null").select("query", "unit", "passage_seq", "dl", "idf", F.size("starts").alias("tf"), "clauses", "n_clauses")
    spans = hits.where("near is not null").select("query", "near", "reach", "unit", "words", "passage_seq", "dl", "idf", "clauses", "n_clauses", F.explode("starts").alias("s"))
    if any(r[3] is not None for r in rows):
        size = spark.createDataFrame(list({(r[0], r[3]): (r[0], r[3], sum(x[0] == r[0] and x[3] == r[3] for x in rows)) for r in rows if r[3] is not None}.values()), "query string, near int, size int")
        last = spans.select("query", "near", "passage_seq", F.col("s").alias("at")).distinct()
        close = last.join(spans, ["query", "near", "passage_seq"]).where((F.col("s") <= F.col("at")) & (F.col("at") - F.col("s") - F.col("words") <= F.col("reach")))
        good = close.groupBy("query", "near", "passage_seq", "at").agg(F.count_distinct("unit").alias("n")).join(size, ["query", "near"]).where("n = size").select("query", "near", "passage_seq", "at")
        kept = close.join(good, ["query", "near", "passage_seq", "at"], "left_semi").select("query", "unit", "passage_seq", "dl", "idf", "clauses", "n_clauses", "s").distinct()
        plain = plain.unionByName(kept.groupBy("query", "unit", "passage_seq", "dl", "idf", "clauses", "n_clauses").agg(F.count("*").cast("int").alias("tf")))
    plain = plain.withColumn("part", F.col("idf") * saturation(index.avgdl, F.col("tf"), F.col("dl")))
    met = F.size(F.array_distinct(F.flatten(F.collect_list("clauses")))).alias("met")
    nested = [F.collect_set("unit").alias("present"), F.collect_list(F.struct("unit", "part")).alias("parts")] if trees else []
    per = plain.groupBy("query", "passage_seq").agg(F.sum("part").alias("score"), met, F.first("n_clauses").alias("n_clauses"), *nested)
    truth, score = F.col("met") == F.col("n_clauses"), F.col("score")
    for name, tree in trees.items():
        present = F.col("present")
        own = F.array_distinct(F.flatten(F.array(*[F.when(c, F.array(F.lit(u))).otherwise(F.array().cast("array<int>")) for u, c in _counted(tree, present, F.lit(True))])))
        total = F.aggregate(F.filter("parts", lambda p: F.array_contains(own, p["unit"])), F.lit(0.0), lambda a, p: a + p["part"])
        truth = F.when(F.col("query") == name, _holds(tree, present)).otherwise(truth)
        score = F.when(F.col("query") == name, total).otherwise(score)
    return per.where(truth).select("query", "passage_seq", score.alias("score"))


def admitted(docs: DataFrame, before: int | None = None, since: int | None = None, types: tuple[str, ...] = (), topics: DataFrame | None = None, without_topics: DataFrame | None = None, without_docs: DataFrame | None = None) -> DataFrame:
    """(doc_id) of the documents that a search admits: year < before, year >=
    since (null years fail both), types, topics (EXISTS), excluded topics and
    ids (NOT EXISTS)."""
    d = docs.select("doc_id", F.col("year").alias("doc_year"), "doc_type", "topics")
    if before is not None:
        d = d.where(F.col("doc_year") < before)
    if since is not None:
        d = d.where(F.col("doc_year") >= since)
    if types:
        d = d.where(F.col("doc_type").isin(*types))
    bridge = d.select("doc_id", F.explode("topics").alias("topic"))
    if topics is not None:
        d = d.join(bridge.join(topics, "topic", "left_semi"), "doc_id", "left_semi")
    if without_topics is not None:
        d = d.join(bridge.join(without_topics, "topic", "left_semi"), "doc_id", "left_anti")
    if without_docs is not None:
        d = d.join(without_docs, "doc_id", "left_anti")
    return d.select("doc_id").distinct()


def filtered_search(index: Index, expressions: list[tuple[str, str]], docs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Ranked hits (query, rank, passage_seq, score) in the admitted ``docs``
    (doc_id), scored over the whole index; and the absences (query, examined): the
    queries without a hit, with how many passages the filters leave."""
    scope = index.places.join(docs, "doc_id", "left_semi").select("passage_seq")
    hits = top(match_search(index, expressions).join(scope, "passage_seq", "left_semi"), "query", limit).select("query", "rank", "passage_seq", "score")
    asked = index.spark.createDataFrame([(n,) for n, _ in expressions], "query string")
    absent = asked.join(hits.select("query").distinct(), "query", "left_anti").crossJoin(F.broadcast(scope.agg(F.count("*").alias("examined"))))
    return hits, absent


def neighbours(seeds: DataFrame, places: DataFrame, window: int = 1) -> DataFrame:
    """Passages at most ``window`` places from a seed in its document: rows
    (seed columns, near_seq, near_ord). Each seed asks for its places, so the
    join is on (doc_id, ord) and a document of very many passages isn't met whole."""
    p = places.select("doc_id", F.col("ord").alias("near_ord"), F.col("passage_seq").alias("near_seq"))
    return seeds.withColumn("near_ord", F.explode(F.sequence(F.col("ord") - window, F.col("ord") + window))).join(p, ["doc_id", "near_ord"])


def passages_of(passages: DataFrame, doc_ids: DataFrame, orders: list[int] | None = None, limit: int = 400) -> DataFrame:
    """The passages of documents, in order, at most ``limit`` a document, only
    those at ``orders`` if given."""
    p = passages.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    p = p if orders is None else p.where(F.col("ord").isin(orders))
    return p.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "passage_seq"))).where(F.col("_n") <= limit).drop("_n")


def match_count(index: Index, expressions: list[tuple[str, str]]) -> DataFrame:
    """(query, n): how many passages satisfy each named expression."""
    asked = index.spark.createDataFrame([(n,) for n, _ in expressions], "query string")
    n = match_search(index, expressions).groupBy("query").agg(F.count("*").alias("n"))
    return asked.join(n, "query", "left").select("query", F.coalesce("n", F.lit(0)).alias("n"))


def alignment(index: Index, passages: DataFrame) -> DataFrame:
    """One row (passage_seq, term, aligned): whether the postings of the longest
    word of the first passage with words name that passage."""
    row = passages.where(F.size(index_tokens(F.col("text"))) > 0).orderBy("passage_seq").select("passage_seq", index_tokens(F.col("text")).alias("ts")).limit(1)
    row = row.select("passage_seq", F.element_at(F.array_sort("ts", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 1).alias("term"))
    hit = index._table("postings").select("passage_seq", "term", F.lit(True).alias("hit"))
    return row.join(hit, ["passage_seq", "term"], "left").select("passage_seq", "term", F.coalesce("hit", F.lit(False)).alias("aligned"))
