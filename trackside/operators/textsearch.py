"""TF-IDF weights and best-match search as joins and aggregates over terms."""

from __future__ import annotations

from functools import cache, cached_property, reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackside.constants import MIN_RELEVANCE
from trackside.session import materialise

# A token is two or more word characters.
WORDS = r"(?U)\b\w\w+\b"
ASCII_WORDS = r"[a-z0-9_]{2,}"
SCORE_DIGITS = 12
LEVELS = 4  # blocks of impact for each halving
MARGIN = 1e-9  # more than sums of impacts differ by their order
COMMON = 1 << 16  # at most so many terms, the most frequent, are looked up without an exchange
STEPS = 4  # steps of document frequency for each doubling
ASKED = 1 << 18  # at most so many terms of questions are searched at once, or those of one question
TASK_ROWS = 1 << 20  # postings in a partition where they are sorted
TASK_PAIRS = 1 << 19  # at most so many pairs of documents and questions in a partition where they are added up
TASK_BYTES = 1 << 26  # of texts in a partition where rows of one id are brought together


@cache
def english_stop_words() -> tuple[str, ...]:
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def _words(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))


def _session_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def term_counts(docs: DataFrame, keys: list[str], words: Column, stop_words) -> DataFrame:
    """(keys, term, tf): words are taken where the texts are read and counted before anything is exchanged."""
    exploded = docs.select(*keys, F.explode(words).alias("term"))
    if stop_words:
        exploded = exploded.where(~F.col("term").isin(list(stop_words)))
    return exploded.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def counted_words(words: Column) -> tuple[Column, Column, Column]:
    """Columns ``_words``, ``_ends`` and ``terms``, each from the one before: a row's words in order, where the runs of equal ones end,
    and an array of (term, tf). Each needs a projection of its own. Nothing but the row is held in memory."""
    at = lambda k: F.get(F.col("_words"), k)
    places = F.when(F.size("_words") > 0, F.sequence(F.lit(1), F.size("_words"))).otherwise(F.array().cast("array<int>"))
    ends = F.filter(places, lambda k: ~at(k).eqNullSafe(at(k - 1)))
    run = lambda end, n: F.struct(
        at(end - 1).alias("term"), (end - F.coalesce(F.get(F.col("_ends"), n - 1), F.lit(0))).cast("bigint").alias("tf")
    )
    return F.sort_array(words), ends, F.transform("_ends", run)


class Corpus:
    """Term statistics of a set of documents, separately per ``by`` group.

    ``id`` is unique within a group; keys are not NULL. ``copies`` names a column that says for how many equal
    documents a row stands, so that repeated texts need to be tokenised only once. Rows that repeat all keys count as one document
    with the words of all; texts are exchanged once for that, or not at all where ``unique`` says that there are none. The words of
    a document are counted inside its row; rows are written to the shared folder once and every reader starts from them.
    """

    def __init__(
        self,
        docs: DataFrame,
        *,
        id: str,
        text: str,
        by: list[str] | None = None,
        copies: str | None = None,
        carry: list[str] | None = None,
        stop_words=None,
        token_pattern: str = WORDS,
        unique: bool = False,
    ):
        self.by, self.id = list(by or []), id
        self.stop_words = english_stop_words() if stop_words is None else tuple(stop_words)
        self.pattern = token_pattern
        count = F.col(copies) if copies else F.lit(1)
        self.carry = [c for c in carry or [] if c not in (*self.by, id)]
        keys = [*self.by, id, *self.carry, "_copies"]
        sizes = [F.sum(count).alias("_docs"), F.count(F.lit(1)).alias("_rows"), F.sum(F.octet_length(text)).alias("_bytes")]
        self.sizes = materialise(docs.groupBy(*self.by).agg(*sizes), "sizes")
        rows = docs.withColumn("_copies", count).select(*keys, F.col(text).alias("_text"))
        if not unique or len(docs.inputFiles()) < docs.sparkSession.sparkContext.defaultParallelism:
            dealt = -(-(self.sizes.agg(F.sum("_bytes")).first()[0] or 0) // TASK_BYTES)
            more = [dealt] if dealt > _session_parts(docs) else []
            rows = rows.repartition(*more, *self.by, id)  # a few files would keep a few cores busy
        if unique:
            words = F.coalesce(_words("_text", token_pattern), F.array().cast("array<string>"))
        else:
            rows = rows.groupBy(*keys).agg(F.collect_list("_text").alias("_texts"))
            every = lambda t: F.regexp_extract_all(F.lower(t), F.lit(token_pattern), F.lit(0))
            words = F.flatten(F.transform("_texts", every))
        if self.stop_words:
            words = F.filter(words, lambda w: ~w.isin(list(self.stop_words)))
        words, ends, terms = counted_words(words)
        rows = rows.select(*keys, words.alias("_words")).select("*", ends.alias("_ends")).select(*keys, terms.alias("terms"))
        self.rows = materialise(rows, "postings")
        self.postings = self._postings(self.rows)
        frequency = self.postings.groupBy(*self.by, "term").agg(F.sum("_copies").alias("df"))
        size = self.sizes.select(*self.by, "_docs")
        if self.by:
            counted = frequency.join(size, self.by)
        else:
            counted = frequency.withColumn("_docs", size.scalar())
        idf = (F.log((1 + F.col("_docs")) / (1 + F.col("df"))) + F.lit(1.0)).alias("idf")
        self._frequencies = materialise(counted.select(*self.by, "term", idf, "df", F.floor(F.log2("df") * STEPS).alias("step")), "idf")
        self.idf = self._frequencies.drop("df", "step")

    def _postings(self, rows: DataFrame) -> DataFrame:
        keys = [c for c in rows.columns if c != "terms"]
        return rows.select(*keys, F.explode("terms").alias("_t")).select(*keys, "_t.term", "_t.tf")

    @cached_property
    def parts(self) -> int:
        """How many partitions postings are dealt over where a task sorts them: as the session says, or more where they are many."""
        n = self.rows.agg(F.sum(F.size("terms"))).first()[0] or 0
        return max(_session_parts(self.rows), -(-n // TASK_ROWS))

    @property
    def many(self) -> bool:
        """Whether postings need more partitions than the session says."""
        return self.parts > _session_parts(self.rows)

    def pair_parts(self, asked: DataFrame, q_id: str) -> int:
        """How many partitions hold at most about ``TASK_PAIRS`` pairs of a document and a question each, ``parts`` at least.

        Pairs are at most all of a group, and at most the postings that the questions' terms meet.
        """
        asking = asked.groupBy(*self.by).agg(F.count_distinct(q_id).alias("_n"))
        together = asking.join(self.sizes, self.by) if self.by else asking.crossJoin(F.broadcast(self.sizes))
        every = together.agg(F.sum(F.col("_n") * F.col("_rows"))).first()[0] or 0
        met = asked.join(self._frequencies, [*self.by, "term"]).agg(F.sum("df")).first()[0] or 0
        return max(self.parts, int(-(-min(every, met) // TASK_PAIRS)))

    @cached_property
    def common(self) -> DataFrame:
        """``idf`` of the most frequent terms: whole steps of document frequency, ``COMMON`` terms at most."""
        steps = sorted(((r.step, r.n) for r in self._frequencies.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect() if r.step is not None), reverse=True)
        least, sum_ = None, 0
        for step, n in steps:
            sum_ += n
            if sum_ > COMMON:
                break
            least = step
        return self._frequencies.where(F.col("step") >= least if least is not None else F.lit(False)).drop("df", "step")

    def _unit(self, weighted: DataFrame, keys: list[str]) -> DataFrame:
        """Scale ``weight`` to length 1 per document or question."""
        length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*keys)))
        return weighted.withColumn("weight", F.col("weight") / length)

    def _weighted(self, dealt: list[str] | None = None) -> DataFrame:
        """Postings with tf * idf as ``weight``, in ``parts`` partitions of the columns ``dealt`` if given.

        Frequent terms, which are most postings, are looked up in a table of bounded size where the postings are read;
        only postings of the others are exchanged by term, and none of their terms makes a skewed partition.
        """
        term = [*self.by, "term"]
        common = F.broadcast(self.common)
        # Rows of documents are shorter than their postings, which are dealt by opening them where the row is.
        postings = self._postings(self.rows.repartition(self.parts, *dealt)) if dealt else self.postings
        rare, idf = postings.join(common.select(*term), term, "left_anti"), self.idf
        if self.many:  # sorted for the join
            rare, idf = rare.repartition(self.parts, *term), idf.repartition(self.parts, *term)
        rare = rare.join(idf, term)
        joined = postings.join(common, term).unionByName(rare.repartition(self.parts, *dealt) if dealt else rare)
        return joined.select(*self.by, self.id, *self.carry, "term", (F.col("tf") * F.col("idf")).alias("weight"))

    def weights(self) -> DataFrame:
        """(by, id, term, weight): one row per document and distinct term, L2-normalised."""
        keys = [*self.by, self.id]
        return self._unit(self._weighted(keys), keys)

    def lengths(self) -> DataFrame:
        """(by, id, length) of the documents' vectors."""
        square = F.sqrt(F.sum(F.col("weight") * F.col("weight")))
        return self._weighted().groupBy(*self.by, self.id).agg(square.alias("length"))

    def asked_rows(self, terms: DataFrame, parts: int | None = None) -> DataFrame:
        """(by, id, carry, number, tf, length) of the postings of ``terms``, dealt by document.

        ``terms`` (by, term, number) are few (see ``tfidf_match``), so other postings are never exchanged.
        """
        doc = [*self.by, self.id]
        rows = self.postings.join(F.broadcast(terms.select(*self.by, "term", "number")), [*self.by, "term"])
        rows = rows.select(*doc, *self.carry, "number", F.col("tf").cast("int").alias("tf"))
        parts = parts or self.parts
        return rows.repartition(parts, *doc).join(self.lengths().repartition(parts, *doc), doc)  # else the lengths' partitions decide

    def question_weights(self, questions: DataFrame, q_id: str, q_text: str) -> DataFrame:
        """(by, q_id, term, q_weight) over known terms."""
        terms = term_counts(questions, [*self.by, q_id], _words(q_text, self.pattern), self.stop_words)
        known = self.idf.join(terms, [*self.by, "term"])
        weighted = known.select(*self.by, q_id, "term", (F.col("tf") * F.col("idf")).alias("weight"))
        return self._unit(weighted, [*self.by, q_id]).withColumnRenamed("weight", "q_weight")


def numbered_terms(corpus: Corpus, asked: DataFrame) -> DataFrame:
    """(by, term, idf, number) of the terms asked for, ``ASKED`` at most."""
    terms = corpus.idf.join(F.broadcast(asked.select(*corpus.by, "term").distinct()), [*corpus.by, "term"])
    return materialise(terms.repartition(1).withColumn("number", F.monotonically_increasing_id().cast("int")), "terms")


def _impact() -> Column:
    return F.col("tf") * F.col("idf") / F.col("length")


def all_scores(corpus: Corpus, asked: DataFrame, q_id: str) -> DataFrame:
    """(by, q_id, id, carry, score) of every document that shares a term with a question.

    Postings asked for are exchanged once, by document; the pairs of documents and questions are made and added up there, in as many
    partitions as keep them in memory.
    """
    terms = numbered_terms(corpus, asked)
    asks = terms.join(asked, [*corpus.by, "term"]).select("number", "idf", q_id, "q_weight")
    pairs = corpus.asked_rows(terms, corpus.pair_parts(asked, q_id)).join(F.broadcast(asks), "number")
    return pairs.groupBy(*corpus.by, q_id, corpus.id, *corpus.carry).agg(F.sum(F.col("q_weight") * _impact()).alias("score"))


class ImpactIndex:
    """An inverted index of the terms that are asked for, and the search for documents that can be a question's best.

    A posting's impact is its normalised weight. The postings of a term fall into blocks of nearly equal impact (``LEVELS`` for
    each halving), of which the greatest impact is kept. A question is answered in steps, none of which loses its best document:

    1. For each of its terms the document of greatest impact is scored exactly; the best of them is the least score to beat.
    2. Its terms that, all together, stay below that score are optional: a better document has one of the others.
    3. Blocks whose impact, with the greatest of all other terms, stays below it are skipped. The other blocks' postings are
       added up per document, and documents that cannot reach it with all optional terms are dropped.
    4. The best partial sum of each question is completed and raises the score to beat; what is left is completed.

    What is kept per question and term is sent to the postings; pairs of documents and questions are added up where a document's
    postings are, so that what is exchanged grows with the postings asked for and not with the pairs.
    """

    def __init__(self, corpus: Corpus, asked: DataFrame, q_id: str):
        by = self.by = corpus.by
        self.id, self.q_id, self.carry = corpus.id, q_id, corpus.carry
        asked = materialise(asked, "asked")
        self.parts = corpus.parts
        self.terms = numbered_terms(corpus, asked)
        kept = [*by, self.id, *self.carry, "length"]
        lists = corpus.asked_rows(self.terms).groupBy(*kept).agg(F.collect_list("number").alias("number"), F.collect_list("tf").alias("tf"))
        self.rows = materialise(lists, "impacts")  # one for each document: numbers are shorter than terms and weights
        self.postings = self.opened(self.rows)
        blocks = self.postings.groupBy(*by, "term", "level").agg(F.max("impact").alias("most"))
        self.blocks = materialise(blocks, "blocks")
        tops = self.postings.groupBy(*by, "term").agg(F.max("impact").alias("most"), F.max_by(corpus.id, "impact").alias("top"))
        reach = F.col("q_weight") * F.col("most")
        self.asked = materialise(asked.join(tops, [*by, "term"]).withColumn("reach", reach).drop("most"), "reaches")

    def opened(self, rows: DataFrame) -> DataFrame:
        """The postings of ``rows`` of documents: (by, id, carry and other columns, term, impact, level)."""
        keep = [c for c in rows.columns if c not in ("number", "tf", "length")]
        each = rows.select(*keep, "length", F.explode(F.arrays_zip("number", "tf")).alias("_t")).select(*keep, "length", "_t.number", "_t.tf")
        found = each.join(F.broadcast(self.terms.select("number", "term", "idf")), "number").withColumn("impact", _impact())
        return found.select(*keep, "term", "impact", F.floor(-F.log2("impact") * LEVELS).cast("int").alias("level"))

    def completed(self, pairs: DataFrame, terms: DataFrame, how: str = "inner") -> DataFrame:
        """``pairs`` of (by, q_id, id, ...) with ``more``, what each of these terms of the question adds to the document's score.

        With ``how="left"`` the document's other terms add 0, so that every pair stays.
        """
        rows = self.rows.drop(*self.carry).join(pairs, [*self.by, self.id])
        weights = F.broadcast(terms.select(*self.by, self.q_id, "term", "q_weight"))
        found = self.opened(rows).join(weights, [*self.by, self.q_id, "term"], how)
        return found.select(*pairs.columns, F.coalesce(F.col("q_weight") * F.col("impact"), F.lit(0.0)).alias("more"))

    def planned(self) -> DataFrame:
        """The questions' terms with the score to beat, whether a term is optional, and the greatest sum of those that are."""
        by, question = self.by, [*self.by, self.q_id]
        first = self.asked.select(*question, F.col("top").alias(self.id)).distinct()
        sums = self.completed(F.broadcast(first), self.asked).groupBy(*question, self.id).agg(F.sum("more").alias("part"))
        beat = sums.groupBy(*question).agg((F.max("part") - MARGIN).alias("beat"))
        each = Window.partitionBy(*question)
        so_far = F.sum("reach").over(each.orderBy("reach", "term").rowsBetween(Window.unboundedPreceding, 0))
        terms = self.asked.drop("top").join(beat, question).withColumn("optional", so_far < F.col("beat"))
        rest = F.coalesce(F.sum(F.when(F.col("optional"), F.col("reach"))).over(each), F.lit(0.0))
        return terms.withColumn("rest", rest).withColumn("others", F.sum("reach").over(each) - F.col("reach"))

    def admitted(self, terms: DataFrame) -> DataFrame:
        """Postings of the blocks that a better document may stand in, as parts of a score."""
        blocks = self.blocks.join(terms.where(~F.col("optional")), [*self.by, "term"])
        blocks = blocks.where(F.col("q_weight") * F.col("most") + F.col("others") >= F.col("beat"))
        # A term's blocks get lower level by level: those of a question end with one level.
        same = [F.first(c).alias(c) for c in ("q_weight", "rest", "beat")]
        deepest = blocks.groupBy(*self.by, self.q_id, "term").agg(F.max("level").alias("_deepest"), *same)
        dealt = self.opened(self.rows.repartition(self.parts, *self.by, self.id))
        found = dealt.join(F.broadcast(deepest), [*self.by, "term"]).where(F.col("level") <= F.col("_deepest"))
        return found.select(
            *self.by, self.q_id, self.id, *self.carry, "rest", "beat", (F.col("q_weight") * F.col("impact")).alias("part")
        )

    def best(self) -> DataFrame:
        """(by, q_id, id, carry, score) of documents that may be a question's best, the best among them."""
        question = [*self.by, self.q_id]
        keys = [*question, self.id, *self.carry]
        terms = materialise(self.planned(), "terms")
        sums = self.admitted(terms).groupBy(*keys).agg(F.sum("part").alias("part"), F.first("rest").alias("rest"), F.first("beat").alias("beat"))
        able = materialise(sums.where(F.col("part") + F.col("rest") >= F.col("beat")), "candidates")
        optional = terms.where("optional")
        leader = able.groupBy(*question).agg(F.max_by(self.id, "part").alias(self.id), F.max("part").alias("part"))
        rest = self.completed(F.broadcast(leader), optional, "left").groupBy(*question).agg(F.sum("more").alias("more"))
        raised = leader.join(rest, question).select(*question, (F.col("part") + F.col("more") - MARGIN).alias("raised"))
        able = able.join(F.broadcast(raised), question).where(F.col("part") + F.col("rest") >= F.col("raised")).select(*keys, "part")
        scores = self.completed(able.repartition(self.parts, *self.by, self.id), optional, "left").groupBy(*keys)
        return scores.agg((F.first("part") + F.sum("more")).alias("score"))


def tfidf(docs: DataFrame, **corpus) -> DataFrame:
    """L2-normalised TF-IDF weights; see ``Corpus`` for the arguments.

    weight = tf * (ln((1 + documents) / (1 + document frequency)) + 1)
    """
    return Corpus(docs, **corpus).weights()


def tfidf_match(
    questions: DataFrame,
    docs: DataFrame,
    *,
    q_id: str,
    q_text: str,
    id: str,
    text: str,
    order: list[str],
    by: list[str] | None = None,
    min_score: float = MIN_RELEVANCE,
    pruned: bool = False,
    **corpus,
) -> DataFrame:
    """For every question the most similar document of its group by cosine of TF-IDF weights.

    Adds the document's ``id``, ``score`` and ``matched`` (score >= ``min_score``). Equal
    scores go to the first document in ``order``; a question that shares no term with any
    document gets the first document and score 0; a group without documents gives NULL.

    ``pruned`` scores only documents that can still be a question's best (see ``ImpactIndex``): the same answers
    with several passes over the postings asked for, which pays where questions meet very many documents.

    Many questions are answered in groups of ``ASKED`` terms, each with a pass of its own: what is broadcast is of bounded size.
    """
    by = list(by or [])
    ranks = [c for c in order if c != id]
    stats = Corpus(docs, id=id, text=text, by=by, carry=ranks, **corpus)
    asked = materialise(stats.question_weights(questions, q_id, q_text), "asked")
    groups = max(1, -(-asked.count() // ASKED))
    group = F.pmod(F.xxhash64(*by, q_id), F.lit(groups))
    search = lambda some: ImpactIndex(stats, some, q_id).best() if pruned else all_scores(stats, some, q_id)
    found = reduce(DataFrame.unionByName, [search(asked.where(group == n) if groups > 1 else asked) for n in range(groups)])
    scored = found.withColumn("score", F.round("score", SCORE_DIGITS))
    place = [part for c in [*ranks, id] for part in (F.col(c).isNull(), F.col(c))]
    best = scored.groupBy(*by, q_id).agg(
        F.min_by(F.struct(id, "score"), F.struct(-F.col("score"), *place)).alias("_best")
    )
    opening = docs.groupBy(*by).agg(F.min_by(id, F.struct(*place)).alias("_first"))
    found = questions.join(best, [*by, q_id], "left")
    if by:
        found = found.join(opening, by, "left")
    else:
        found = found.withColumn("_first", opening.scalar())
    score = F.when(F.coalesce(F.col("_best")[id], F.col("_first")).isNotNull(), F.coalesce("_best.score", F.lit(0.0)))
    return found.select(
        *[F.col(c) for c in questions.columns],
        F.coalesce(F.col("_best")[id], F.col("_first")).alias(id),
        score.alias("score"),
        F.coalesce(score >= min_score, F.lit(False)).alias("matched"),
    )
