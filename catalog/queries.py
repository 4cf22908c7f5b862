"""One query per operator, each over whole tables.

Roles of the tables: a document is a file of one page (its lines are pages where pages
matter), ``embeddings`` are indexed points, ``benchmark`` holds the questions,
``conversations`` the chat messages, ``labels`` the verdicts of a judge, and the URLs of
``pages`` are file names and service addresses.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import constants as C
from folioscope.functions import payload as payload_fn
from folioscope.functions import text as text_fn
from folioscope.functions.judge import chat_content, embedding_values, parse_reply
from folioscope.functions.vectors import cosine
from folioscope.models.calls import CallStore
from folioscope.models.columns import embed_column, summary_column
from folioscope.models.hashing import HashingEmbedder
from folioscope.models.offline import LineJudge
from folioscope.operators import answers, chat, chunking, evaluation
from folioscope.operators.files import first_copies, new_files, with_hash
from folioscope.operators.lists import LISTS, PROBES, InvertedLists
from folioscope.operators.search import top_k
from folioscope.plans.answer import answer, chat_prompts, chat_turns as reply_to_open_questions, whole_prompts
from folioscope.plans.evaluate import all_scores, correctness_scores, evaluation_table, faithfulness_scores, judge_relevancy, judged_scores, relevancy_scores
from folioscope.plans.ingest import build_points, file_chunks, ingest
from folioscope.plans.replay import replay
from folioscope.plans.retrieve import Retriever, naive_retriever, reranked_retriever, text_retriever
from folioscope.schemas import VECTOR
from folioscope.session import fresh_folder, stored, work_folder
from folioscope.sources.files import file_text, read_questions, scan_folder, text_parser
from folioscope.sources.index import ALL_POINTS, Collection, collection_report, keep_latest, sample_files
from folioscope.streaming.ingest import start_ingest
from folioscope.streaming.memory import history_stream

Query = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, Query] = {}
_ONE_WRITER = threading.Lock()

SCORE_DECIMALS = 6
PROBE_SALTS = 16

#: Turns per page in the registered queries, so that conversations have several pages.
QUERY_PAGE_TURNS = 3


def query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


# --- inputs ------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream, whether the table is one file or a folder of them.

    A stream's path must be a folder or a pattern, so the name is given as a pattern that only it matches.
    """
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def embedder(size: int = C.VECTOR_SIZE):
    return lambda: HashingEmbedder(size)


def document_name() -> Column:
    return F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt"))


def as_files(documents: DataFrame) -> DataFrame:
    """Documents as text files of one page."""
    name = document_name()
    return documents.select(
        name.alias("path"), name.alias("file_name"), F.col("text").cast("binary").alias("content")
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def rounded(score: Column) -> Column:
    return F.round(score, SCORE_DECIMALS)


def document_collection(spark: SparkSession, sf_dir: str) -> Collection:
    """The index of all documents: ingested by the first query of a session that needs it."""
    name = "documents-" + hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
    collection = Collection(spark, work_folder(spark), name)
    with _ONE_WRITER:
        if collection.last_ingest() == 0:
            ingest(as_files(table(spark, sf_dir, "documents")), collection, text_parser)
    return collection


# --- files -------------------------------------------------------------------


@query
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", text_fn.content_hash(F.col("text")).alias("file_hash"))


@query
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = content_hash(spark, sf_dir)
    return first_copies(hashed, "doc_id")


@query
def incremental_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files when the labelled documents are already indexed."""
    hashed = content_hash(spark, sf_dir)
    indexed = hashed.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return new_files(hashed, indexed, "doc_id")


@query
def exists_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's content occurs among the labelled documents."""
    hashed = content_hash(spark, sf_dir)
    indexed = hashed.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    # The right side is reduced to distinct hashes, so copies do not multiply rows, and repeated for
    # each salt, so that a content that makes up much of the left side is not one task's work.
    salts = F.explode(F.sequence(F.lit(0), F.lit(PROBE_SALTS - 1)))
    known = indexed.select("file_hash").distinct().select("file_hash", salts.alias("salt"), F.lit(True).alias("known"))
    salted = hashed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(PROBE_SALTS)).cast("int"))
    return salted.join(known, ["file_hash", "salt"], "left").select(
        "doc_id", F.coalesce("known", F.lit(False)).alias("already_indexed")
    )


@query
def ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url").where(text_fn.has_suffix(F.col("url"), ".html"))


@query
def embed_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text_fn.embed_endpoint(F.col("url")).alias("endpoint"))


@query
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pages, numbered from 1; blank ones are left out without renumbering."""
    numbered = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(text_fn.lines(F.col("text"))).alias("at", "text")
    )
    return numbered.where(text_fn.has_text(F.col("text"))).select(
        "doc_id", (F.col("at") + 1).alias("page_number"), "text"
    )


@query
def stripped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(text_fn.nonblank_lines(F.col("text"))).alias("line_index", "text")
    )


@query
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files, found again by their suffix and read line by line."""
    folder = fresh_folder(spark, "texts")
    table(spark, sf_dir, "documents").select("text").write.text(folder)
    content = scan_folder(spark, folder, ".TXT").select(F.decode("content", "UTF-8").alias("text"))
    lines = content.select(F.explode(text_fn.nonblank_lines(F.col("text"))).alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query
def joined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a file in order with nothing between them, with lines as pages."""
    documents = table(spark, sf_dir, "documents")
    paged = documents.select(
        "doc_id", F.encode(F.replace("text", F.lit("\n"), F.lit("\f")), "UTF-8").alias("content")
    )
    return file_text(paged, text_parser)


@query
def question_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions written as JSON lines, with the true answer under either name, and read back."""
    folder = fresh_folder(spark, "questions")
    even = F.col("question_id") % 2 == 0
    questions(spark, sf_dir).select(
        "question",
        F.when(even, F.concat(F.lit("first: "), "question")).alias("ground_truth"),
        F.when(~even, F.concat(F.lit("second: "), "question")).alias("answer"),
    ).write.json(folder)
    return evaluation.ground_truth(read_questions(spark, folder, one_array=False))


# --- chunks and points -------------------------------------------------------


@query
def chunk_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.explode_chunks(documents, chunking.line_chunk_column(F.col("text")))


@query
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.explode_chunks(documents, chunking.recursive_chunk_column(F.col("text")))


@query
def chunk_recursive_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short chunks, for which pieces are cut again at finer and finer separators."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.explode_chunks(documents, chunking.recursive_chunk_column(F.col("text"), 60, 15))


@query
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_lengths(chunk_naive(spark, sf_dir), "doc_id")


@query
def summary_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", summary_column(F.col("text")).alias("summary")
    )


@query
def summary_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", text_fn.summary_cut_if_long(F.col("text")).alias("summary")
    )


def _points(spark: SparkSession, sf_dir: str, granularity: str) -> DataFrame:
    files = with_hash(as_files(table(spark, sf_dir, "documents"))).select(
        "file_hash", "file_name", "content"
    )
    points = build_points(file_chunks(files, text_parser, granularity, spread=False), None)
    return points.select("id", "payload.*")


@query
def page_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and payloads of the points of every document, page by page."""
    return _points(spark, sf_dir, "page")


@query
def document_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with whole documents as the unit of chunking."""
    return _points(spark, sf_dir, "document")


@query
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero elements of the offline vector of every document.

    As in ingestion, texts are redistributed before the model is called, because a
    row group of texts is little to read and much to embed.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    vectors = documents.select(
        "doc_id", embed_column(embedder(), F.col("text")).alias("vector")
    )
    return (
        vectors.select("doc_id", F.posexplode("vector").alias("element", "weight"))
        .where(F.col("weight") != 0)
        .withColumn("weight", F.col("weight").cast("double"))
    )


@query
def ingest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest all documents twice into a new collection; the second run adds nothing."""
    files = as_files(table(spark, sf_dir, "documents"))
    collection = Collection(spark, fresh_folder(spark, "ingest"))
    ingest(files, collection, text_parser)
    ingest(files, collection, text_parser)
    return collection.files().drop("path", "ingest")


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream."""
    folder = fresh_folder(spark, "stream-ingest")
    documents = table_stream(spark, sf_dir, "documents")
    collection = Collection(spark, folder)
    start_ingest(as_files(documents), collection, text_parser, f"{folder}/checkpoint").awaitTermination()
    return collection.files().drop("path", "ingest")


@query
def ingested_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as they are read back from the index."""
    points = document_collection(spark, sf_dir).points()
    return points.select("id", F.size("vector").alias("vector_size"), "payload.*")


@query
def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded points replaced by relabelled ones where the document of that id has a label."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    relabelled = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("vec_id"), (F.col("quality") + 100).alias("label")
    )
    # Every label arrives twice, first an old one.
    stale = relabelled.withColumn("label", F.lit(0))
    arrived = stale.withColumn("version", F.lit(1)).unionByName(relabelled.withColumn("version", F.lit(2)))
    merged = keep_latest(points.withColumn("version", F.lit(0)), arrived, "vec_id", F.col("version"))
    return merged.drop("version")


# --- reading the collection --------------------------------------------------


@query
def collection_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection_report(document_collection(spark, sf_dir).points())


@query
def collection_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared vector size and metric, with the number of files and points behind them."""
    collection = document_collection(spark, sf_dir)
    ledger = collection.files().agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_chunks").alias("n_points")
    )
    size, metric = collection.properties().select("vector_size", "metric").first()
    return ledger.select(
        "n_files", "n_points", F.lit(size).alias("vector_size"), F.lit(metric).alias("metric")
    )


@query
def sample_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_files(document_collection(spark, sf_dir).points())


@query
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that match two keywords."""
    documents = table(spark, sf_dir, "documents")
    payload = {"lang": F.col("lang"), "source": F.col("source")}
    return documents.select("doc_id", "lang", "source").where(
        payload_fn.matches_all(payload, {"lang": "en", "source": "src1"})
    )


@query
def collection_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten points of the collection that match a keyword."""
    return document_collection(spark, sf_dir).scroll({"page_number": "1"}).select("id", "payload.*")


@query
def scroll_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two points shown after an ingest."""
    return document_collection(spark, sf_dir).scroll(limit=2).select("id", "payload.*")


@query
def scroll_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of ten points in which all of the collection can be scrolled."""
    return document_collection(spark, sf_dir).pages(C.SAMPLE_POINTS)


@query
def payload_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the seven indexed fields, with its number of points, from the index alone."""
    entries = document_collection(spark, sf_dir).entries().where(F.col("field") != ALL_POINTS)
    return entries.groupBy("field", "value").agg(F.sum("n").alias("n"))


@query
def upsert_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection in which labelled documents got their verdict as keyword, and before that."""
    files = as_files(table(spark, sf_dir, "documents"))
    collection = Collection(spark, fresh_folder(spark, "upsert"))
    ingest(files, collection, text_parser)
    before = collection.last_ingest()
    verdicts = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").cast("string").alias("doc")).agg(F.max("quality").alias("quality"))
    doc = F.regexp_extract("payload.file_name", "-([0-9]+)\\.txt$", 1)
    labelled = collection.points().withColumn("doc", doc).join(verdicts, "doc")
    keyword = F.concat(F.lit("quality "), F.col("quality").cast("string"))
    collection.upsert(labelled.select("id", "vector", F.col("payload").withField("keywords", keyword).alias("payload")))
    now = collection.points().select("id", "payload.file_name", F.col("payload.keywords").alias("keywords"))
    earlier = collection.points(before).select("id", F.col("payload.keywords").alias("keywords_before"), F.lit(True).alias("was_there"))
    return now.join(earlier, "id", "left")


def _payload_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as payload maps: for German ones the source key is absent, for French
    ones it is present and null; only some have a page."""
    empty = F.expr("map()").cast("map<string,string>")
    source = F.when(F.col("lang") != "fr", F.col("source"))
    payload = F.map_concat(
        F.create_map(F.lit("text"), F.col("text"), F.lit("lang"), F.col("lang")),
        F.when(F.col("lang") != "de", F.create_map(F.lit("source"), source)).otherwise(empty),
        F.when(
            F.startswith("source", F.lit("src1")),
            F.create_map(F.lit("page"), F.col("n_chars").cast("string")),
        ).otherwise(empty),
    )
    return table(spark, sf_dir, "documents").select("doc_id", payload.alias("payload"))


@query
def payload_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.col("payload")
    return _payload_maps(spark, sf_dir).select(
        "doc_id",
        payload_fn.get_or(payload, "text", "").alias("text"),
        payload_fn.get_or(payload, "source", C.MISSING_SOURCE).alias("source"),
        payload_fn.get_or(payload, "page", C.MISSING_PAGE).alias("page"),
        payload_fn.has_key(payload, "source").alias("has_source"),
    )


@query
def metadata_minus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = payload_fn.without_text(F.col("payload"))
    return _payload_maps(spark, sf_dir).select(
        "doc_id", F.explode(rest).alias("field", "value")
    )


# --- retrieval ---------------------------------------------------------------


def _embedding_search(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector")
    )
    asked = questions(spark, sf_dir).select(
        "question_id", embed_column(embedder(64), F.col("question")).alias("vector")
    )
    return top_k(asked, points, k).withColumn("score", rounded(F.col("score")))


@query
def vector_topk5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions against all embedded points."""
    return _embedding_search(spark, sf_dir, C.TOP_K)


@query
def vector_topk25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedding_search(spark, sf_dir, C.OVER_RETRIEVE_K)


def _listed_search(spark: SparkSession, sf_dir: str, probes: int) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = questions(spark, sf_dir).select("question_id", embed_column(embedder(64), F.col("question")).alias("vector"))
    index = InvertedLists.build(points, fresh_folder(spark, "lists"))
    return index.top_k(asked, C.TOP_K, probes).withColumn("score", rounded(F.col("score")))


@query
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exact hits of all questions there are, and whether nine tenths are found by
    looking at the usual number of inverted lists."""
    exact = stored(_embedding_search(spark, sf_dir, C.TOP_K).select("question_id", "id"), "exact")
    near = stored(_listed_search(spark, sf_dir, PROBES).select("question_id", "id", F.lit(1).alias("found")), "near")
    both = exact.join(near, ["question_id", "id"], "left")
    return both.agg(F.count(F.lit(1)).alias("n_exact"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("nine_tenths_found"))


@query
def ann_topk5_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all lists, which is the exact search."""
    return _listed_search(spark, sf_dir, LISTS)


def _retrieved(retriever: Retriever, asked: DataFrame) -> DataFrame:
    return retriever.retrieve(asked).select(
        "question_id",
        "position",
        "id",
        rounded(F.col("score")).alias("score"),
        "source",
        "page",
        "reference_number",
        "page_content",
    )


@query
def text_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five chat messages nearest to every question, from vectors kept in the session."""
    texts = messages(spark, sf_dir).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text"
    )
    found = text_retriever(texts, embedder()).retrieve(questions(spark, sf_dir))
    return found.select("question_id", "position", "id", rounded(F.col("score")).alias("score"), "page_content")


@query
def naive_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest chunks of every question, with the citation at the end."""
    retriever = naive_retriever(document_collection(spark, sf_dir))
    return _retrieved(retriever, questions(spark, sf_dir))


@query
def hit_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All payload fields but the text, and the score, of the five nearest chunks."""
    points = document_collection(spark, sf_dir).points()
    asked = questions(spark, sf_dir).select(
        "question_id", embed_column(embedder(), F.col("question")).alias("vector")
    )
    hits = stored(top_k(asked, points, C.TOP_K), "hits").withColumn("score", rounded(F.col("score")))
    found = answers.hit_metadata(hits, points)
    return found.select("question_id", "rank", F.explode("metadata").alias("field", "value"))


@query
def citation_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = naive_retriever(document_collection(spark, sf_dir), citation="prefix")
    return _retrieved(retriever, questions(spark, sf_dir))


@query
def citation_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and page looked up under names the points do not have."""
    retriever = naive_retriever(document_collection(spark, sf_dir), strict_keys=True)
    return _retrieved(retriever, questions(spark, sf_dir))


@query
def reranked_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of the 25 nearest chunks of every question; citations keep the search rank."""
    retriever = reranked_retriever(document_collection(spark, sf_dir))
    return _retrieved(retriever, questions(spark, sf_dir))


@query
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = reranked_retriever(document_collection(spark, sf_dir))
    return answers.assemble(retriever.retrieve(questions(spark, sf_dir))).drop("contexts")


@query
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = reranked_retriever(document_collection(spark, sf_dir))
    return answer(questions(spark, sf_dir), retriever).select("question_id", "prompt")


@query
def prompt_with_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever = naive_retriever(document_collection(spark, sf_dir))
    answered = answer(questions(spark, sf_dir), retriever, template="cited_with_references")
    return answered.select("question_id", "prompt")


# --- chat --------------------------------------------------------------------


@query
def message_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.with_position(messages(spark, sf_dir), "conv_id").select("conv_id", "turn", "position")


@query
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.message_pairs(messages(spark, sf_dir), "conv_id")


@query
def pairs_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.message_pairs(messages(spark, sf_dir), "conv_id")
    return chat.newest_first(pairs, "conv_id").select("conv_id", "pair_index", "display_position")


@query
def render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.message_pairs(messages(spark, sf_dir), "conv_id")
    return chat.pair_html(pairs).select("conv_id", "pair_index", "html")


@query
def render_raw_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.message_pairs(messages(spark, sf_dir), "conv_id")
    return chat.pair_html(pairs, escape=False).select("conv_id", "pair_index", "html")


@query
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier turns of the same page of three; earlier pages are those of ``history_pages``."""
    tails = chat.with_history_tail(messages(spark, sf_dir), "conv_id", page_turns=QUERY_PAGE_TURNS)
    return tails.select("conv_id", "turn", "page", "history_tail")


@query
def history_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in pages of three turns."""
    return chat.history_pages(messages(spark, sf_dir), "conv_id", page_turns=QUERY_PAGE_TURNS)


@query
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``history_window`` from a stateful stream."""
    folder = fresh_folder(spark, "stream-history")
    rows = history_stream(table_stream(spark, sf_dir, "conversations"), "conv_id", page_turns=QUERY_PAGE_TURNS)
    started = (
        rows.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@query
def latest_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.latest_questions(messages(spark, sf_dir), "conv_id").select("conv_id", "turn", "text")


@query
def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.open_questions(messages(spark, sf_dir), "conv_id").select("conv_id", "turn", "text")


@query
def chat_prompt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of the latest question of every conversation: reranked context, history, question."""
    retriever = reranked_retriever(document_collection(spark, sf_dir))
    return chat_prompts(messages(spark, sf_dir), retriever, "conv_id", page_turns=QUERY_PAGE_TURNS)


@query
def chat_whole_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the parts of each prompt joined: the whole history in one text."""
    # A page of a conversation has a message, and a prompt two more parts.
    parts, rows = chat_prompt_parts(spark, sf_dir), messages(spark, sf_dir).count()
    return whole_prompts(parts, "conv_id", rows)


@query
def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reply to every conversation that ends with a question, as its next message."""
    retriever = reranked_retriever(document_collection(spark, sf_dir))
    return reply_to_open_questions(messages(spark, sf_dir), retriever, session="conv_id")


@query
def replayed_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions of all conversations, each prompt with the replies given before it."""
    retriever = naive_retriever(document_collection(spark, sf_dir), k=1)
    replies = replay(messages(spark, sf_dir), retriever, session="conv_id", hashed=True)
    return replies.select("conv_id", "turn", F.col("round").alias("question_number"), "prompt_hash", "answer")


@query
def stored_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents and messages, distinct ones, and the model calls of a first and a second run."""
    store = CallStore(spark, fresh_folder(spark, "calls"))
    texts = {"documents": table(spark, sf_dir, "documents"), "conversations": messages(spark, sf_dir)}
    rows = None
    for name, frame in texts.items():
        counts = []
        for _ in range(2):
            found = store.call(frame.select("text"), "text", "hashing", lambda text: embed_column(embedder(), text), "vector")
            counts.append(store.results("hashing", VECTOR).count())
        row = found.agg(F.count("vector").alias("n_vectors"), F.count_distinct("text").alias("n_distinct"))
        row = row.select(F.lit(name).alias("source"), "*", F.lit(counts[0]).alias("calls"), F.lit(counts[1]).alias("calls_after_rerun"))
        rows = row if rows is None else rows.unionAll(row)
    return rows


# --- evaluation --------------------------------------------------------------


def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all questions; the text of the next item, a stand-in, is the true answer."""
    asked = questions(spark, sf_dir)
    following = asked.select((F.col("question_id") - 1).alias("question_id"), F.col("question").alias("following"))
    items = asked.join(following, "question_id", "left").select(
        "question_id", "question", F.coalesce("following", "question").alias("ground_truth")
    )
    return evaluation_table(items, naive_retriever(document_collection(spark, sf_dir)))


@query
def eval_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows of all questions, one line per context."""
    return _evaluation(spark, sf_dir).select(
        "question_id",
        "question",
        "answer",
        "ground_truth",
        F.posexplode_outer("contexts").alias("context_index", "context"),
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = questions(spark, sf_dir).withColumn("ground_truth", F.col("question"))
    answered = evaluation_table(items, reranked_retriever(document_collection(spark, sf_dir)))
    return judge_relevancy(answered, LineJudge, CallStore(spark, fresh_folder(spark, "judged")), "lines")


@query
def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's answer judged statement by statement."""
    judged = _judged(spark, sf_dir).withColumn("n_statements", F.size("statements"))
    return judged.select("question_id", rounded(F.col("score")).alias("score"), "success", "n_statements", F.array_join("statements", "\n").alias("statements"))


@query
def judge_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).agg(
        rounded(F.avg("score")).alias("mean_score"), F.count_if("success").alias("n_success"), F.count(F.lit(1)).alias("n_questions")
    )


@query
def reranked_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranked documents cited by their new positions, with the source in front."""
    retriever = reranked_retriever(document_collection(spark, sf_dir), renumber=True, citation="prefix")
    return _retrieved(retriever, questions(spark, sf_dir))


@query
def answer_relevancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = relevancy_scores(_evaluation(spark, sf_dir), embedder())
    return scores.select("question_id", rounded(F.col("answer_relevancy")).alias("answer_relevancy"))


@query
def answer_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = correctness_scores(_evaluation(spark, sf_dir), embedder())
    return scores.select(
        "question_id",
        *(rounded(F.col(c)).alias(c) for c in ("f1", "similarity", "answer_correctness")),
    )


@query
def answer_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = faithfulness_scores(_evaluation(spark, sf_dir))
    return scores.withColumn("faithfulness", rounded(F.col("faithfulness")))


@query
def metric_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the metrics over all questions."""
    return all_scores(_evaluation(spark, sf_dir), embedder()).agg(
        rounded(F.avg("faithfulness")).alias("faithfulness"),
        rounded(F.avg("answer_relevancy")).alias("answer_relevancy"),
        rounded(F.avg("answer_correctness")).alias("answer_correctness"),
        F.count(F.lit(1)).alias("n_questions"),
    )


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as verdicts over statements, with the document source as the question."""
    return table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id"
    )


@query
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = evaluation.faithfulness(_verdicts(spark, sf_dir), "source", supported="quality")
    return shares.withColumn("faithfulness", rounded(F.col("faithfulness")))


@query
def relevant_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant = _verdicts(spark, sf_dir).withColumn("relevant", F.col("toxic") == 0)
    shares = evaluation.relevant_share(relevant.withColumn("relevant", F.col("relevant").cast("int")), "source")
    return shares.withColumn("answer_relevancy", rounded(F.col("answer_relevancy")))


@query
def statement_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 per source: supported statements, unsupported ones, and toxic ones as missed."""
    counted = _verdicts(spark, sf_dir).groupBy("source").agg(
        F.sum("quality").alias("tp"),
        F.sum(1 - F.col("quality")).alias("fp"),
        F.sum("toxic").alias("fn"),
    )
    return counted.withColumn(
        "f1", rounded(evaluation.statement_f1(F.col("tp"), F.col("fp"), F.col("fn")))
    )


@query
def avg_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = evaluation.mean_score(table(spark, sf_dir, "labels"), score="quality")
    return mean.select(
        rounded(F.col("mean_score")).alias("mean_score"),
        text_fn.three_decimals(F.col("mean_score")).alias("mean_label"),
        "n_results",
    )


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies of every shape, made from the events: object, array, scalar, text after
    the JSON, object without statements, plain lines, verdicts that are no list, repeated keys."""
    kind, word, props = F.col("event_id") % 8, F.col("event_type"), F.col("props")
    pair = F.concat(F.lit('["'), word, F.lit('", "'), F.col("user_id").cast("string"), F.lit('"]'))
    full = F.concat(F.lit('{"statements": '), pair, F.lit(', "verdicts": ["yes", "'), word, F.lit('"]}'))
    reply = (
        F.when(kind == 0, full)
        .when(kind == 1, pair)
        .when(kind == 2, F.get_json_object(props, "$.k"))
        .when(kind == 3, F.concat(full, F.lit("\nDone. ")))
        .when(kind == 4, props)
        .when(kind == 5, F.concat(F.lit("  "), word, F.lit("\n\n is "), props, F.lit(" \n")))
        .when(kind == 6, F.concat(F.lit('{"statements": '), pair, F.lit(', "verdicts": "none"}')))
        .otherwise(F.concat(F.lit('{"a": 1, "statements": '), pair, F.lit(', "a": 2}')))
    )
    return table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))


@query
def judge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies parsed by shape, or by line where they are not JSON."""
    parsed = _replies(spark, sf_dir).select("event_id", parse_reply(F.col("reply")).alias("judged"))
    return parsed.select(
        "event_id",
        "judged.output",
        F.array_join("judged.statements", "|").alias("statements"),
        F.size("judged.statements").alias("n_statements"),
        F.array_join("judged.verdicts", "|").alias("verdicts"),
    )


@query
def judged_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies to the questions, scored by their verdicts: mean and successes per question."""
    asked = questions(spark, sf_dir)
    n_questions = asked.count()
    replies = _replies(spark, sf_dir).select(
        (F.col("event_id") % n_questions).alias("question_id"), parse_reply(F.col("reply")).alias("judged")
    )
    scored = judged_scores(replies.join(asked, "question_id"))
    return scored.groupBy("question_id").agg(
        rounded(F.avg("score")).alias("mean_score"),
        F.count_if("success").alias("n_successes"),
        F.sum(F.size("judged.statements")).alias("n_statements"),
        F.count(F.lit(1)).alias("n_replies"),
    )


@query
def service_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message text and vector out of service responses."""
    chosen = F.to_json(
        F.struct(F.array(F.struct(F.struct(F.col("event_type").alias("content")).alias("message"))).alias("choices"))
    )
    vector = F.to_json(F.struct(F.array(F.col("value"), F.col("value") * 2).alias("embedding")))
    return table(spark, sf_dir, "events").select(
        "event_id",
        chat_content(chosen).alias("content"),
        rounded(embedding_values(vector)[1].cast("double")).alias("second"),
    )


@query
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of each user with a value of 50 or more, in the order of event ids."""
    worked = F.col("value") >= 50
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min_by("event_type", F.when(worked, F.col("event_id"))).alias("first_working"),
        F.count_if(~worked).alias("n_failures"),
    )


@query
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine between every point's vector and that of the next id."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = points.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return points.join(following, "vec_id").select(
        "vec_id", rounded(cosine(F.col("embedding"), F.col("next"))).alias("similarity")
    )
