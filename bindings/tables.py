"""Spark side of the shared steps: test tables as operator inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proofloom.functions import text as tx
from proofloom.operators import chunking as ch
from proofloom.operators.lexical import LexicalIndex, build_index
from proofloom.session import stored
from proofloom.sources import documents as src

K = 5


def show(value, name: str | None = None) -> Column:
    """Six decimals, nudged off the tie so that both engines round alike."""
    column = F.col(value) if isinstance(value, str) else value
    rounded = F.round(column + F.lit(2e-10), 6)
    name = name or (value if isinstance(value, str) else None)
    return rounded.alias(name) if name else rounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str, schema: StructType) -> DataFrame:
    """A table as a stream of its files; the pattern lets it be one file or a folder."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return src.read_documents(spark, f"{sf_dir}/documents.parquet", *(columns or ("doc_id", "text")))


def pages(spark, sf_dir) -> DataFrame:
    return src.document_pages(documents(spark, sf_dir))


def blocks(spark, sf_dir) -> DataFrame:
    return src.document_blocks(documents(spark, sf_dir))


_STORED: dict[tuple[str, str], DataFrame] = {}
_INDEXES: dict[tuple[str, str], LexicalIndex] = {}


def chunks(spark, sf_dir) -> DataFrame:
    """The chunk table, ingested once per session and read by every query that needs chunks."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = stored(fresh_chunks(spark, sf_dir), "chunks")
    return _STORED[key]


def index(spark, sf_dir) -> LexicalIndex:
    """The lexical index of the chunk table, written once per session and read by every query set."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = build_index(chunks(spark, sf_dir))
    return _INDEXES[key]


def fresh_chunks(spark, sf_dir) -> DataFrame:
    return ch.chunks_from_documents(documents(spark, sf_dir))


def queries(spark, sf_dir) -> DataFrame:
    """Benchmark passages as questions; odd ones lean on BM25."""
    odd = F.col("item_id") % 2 == 1
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query"),
        F.concat(F.lit("Passage "), F.col("item_id").cast("string")).alias("title"),
        F.when(odd, 0.7).otherwise(0.5).alias("bm25_weight"),
        F.when(odd, 0.3).otherwise(0.5).alias("semantic_weight"),
    )


def vector_chunks(spark, sf_dir) -> DataFrame:
    """Chunks with a stored vector each, taken from the embeddings table by number."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return (
        chunks(spark, sf_dir)
        .withColumn("vec_id", (F.col("doc_id") * 7 + F.col("chunk_index")) % vectors.count())
        .join(vectors, "vec_id")
        .drop("vec_id")
    )


def stored_vector_chunks(spark, sf_dir) -> DataFrame:
    """The same, written once: several steps of a query read it."""
    return stored(vector_chunks(spark, sf_dir), "chunks")


def vector_queries(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return queries(spark, sf_dir).join(vectors, "query_id")


def parts(spark, sf_dir) -> DataFrame:
    """Chunks with their first and last sentence, free of quotes and backslashes."""
    safe = F.replace(F.replace("text", F.lit("\\"), F.lit("")), F.lit('"'), F.lit(""))
    split = chunks(spark, sf_dir).withColumn("_s", tx.sentence_array(safe))
    first = F.element_at("_s", 1)
    return split.select(
        "doc_id",
        "chunk_index",
        request_id(),
        "page_num",
        "text",
        first.alias("first"),
        F.element_at("_s", -1).alias("last"),
        F.array_join(F.reverse(F.split(first, " ")), " ").alias("turned"),
    )


def request_id() -> Column:
    """One request per chunk."""
    return F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("request_id")


def sub_prompts(spark, sf_dir) -> DataFrame:
    pair = F.array(
        F.struct(F.lit(1).alias("number"), F.lit("Main point").alias("title"), F.lit("What is said").alias("sub_prompt")),
        F.struct(F.lit(2).alias("number"), F.lit("Evidence check").alias("title"), F.lit("What proves it").alias("sub_prompt")),
    )
    return chunks(spark, sf_dir).select(request_id(), F.explode(pair).alias("s")).select("request_id", "s.*")


def responses(spark, sf_dir) -> DataFrame:
    """Model answers built from chunks: bare, fenced, wrapped in prose, cut off, or loosely shaped."""
    rows = parts(spark, sf_dir).withColumn("kind", ((F.col("doc_id") + F.col("chunk_index")) % 5).cast("long"))
    head = F.concat(
        F.lit('{"analyses":[{"sub_prompt_index":1,"sub_prompt_title":"Main point","sub_prompt_analyzed":"What is said","analysis_summary":"'),
        "first", F.lit('","supporting_quotes":["'), "first", F.lit('","'), "turned",
        F.lit('"],"analysis_context":"chunk '), F.col("chunk_index").cast("string"), F.lit('"}'),
    )
    second = F.concat(
        F.lit(',{"sub_prompt_index":2,"analysis_summary":"'), "last", F.lit('","supporting_quotes":["**'), "last",
        F.lit('**","zzqx vvkw jjpf"],"analysis_context":""}'),
    )
    loose = F.concat(
        F.lit(',{"analysis_summary":"'), "last", F.lit('","supporting_quotes":"'), "last",
        F.lit('"},{"sub_prompt_index":7,"sub_prompt_title":"Extra","analysis_summary":"more"}'),
    )
    end = F.lit("]}")
    kind = F.col("kind")
    response = (
        F.when(kind == 0, F.concat(head, second, end))
        .when(kind == 1, F.concat(F.lit("```json\n"), head, second, end, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here is the result: "), head, end, F.lit(" I hope it helps.")))
        .when(kind == 3, F.left(head, F.length(head) - 20))
        .otherwise(F.concat(head, loose, end))
    )
    return rows.select("request_id", "doc_id", "chunk_index", "kind", response.alias("response"))


def split_request(rows: DataFrame) -> DataFrame:
    """Document and chunk number back from the request id."""
    ids = F.split("request_id", "-")
    return rows.withColumn("doc_id", F.get(ids, F.lit(0)).cast("long")).withColumn("chunk_index", F.get(ids, F.lit(1)).cast("int"))


def fact_responses(spark, sf_dir) -> DataFrame:
    """Three fact attempts per chunk: clean, missing, cut off, with a weak fact, with an unknown type."""
    rows = parts(spark, sf_dir).withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    k = (F.col("doc_id") + 3 * F.col("chunk_index") + F.col("attempt") * F.col("attempt")) % 5
    good = F.concat(
        F.lit('{"fact_name":"Length","fact_value":"'), F.length("text").cast("string"),
        F.lit(' characters","fact_type":"amount","confidence":0.9,"metadata":{"page":"'), F.col("page_num").cast("string"),
        F.lit('"}},{"fact_name":" Opening ","fact_value":"'), "first",
        F.lit('","confidence":0.8,"source_text":"chunk '), F.col("chunk_index").cast("string"), F.lit('"}'),
    )
    begin = F.lit('{"extracted_facts":[')
    odd = F.lit(',{"fact_name":"Oddity","fact_value":"odd","fact_type":"mystery","confidence":0.4}],"fact_types_found":["amount"]}')
    weak = F.lit(',{"fact_name":"Rate","fact_value":"unknown","fact_type":"percentage","confidence":0.7}],"fact_types_found":["percentage"]}')
    response = (
        F.when(k == 0, F.concat(F.lit("```json\n"), begin, good, odd, F.lit("\n```")))
        .when(k == 1, F.lit(None).cast("string"))
        .when(k == 2, F.concat(begin, good))
        .when(k == 3, F.concat(begin, good, weak))
        .otherwise(F.concat(begin, good, F.lit('],"fact_types_found":["mystery"]}')))
    )
    return rows.select("request_id", "attempt", response.alias("response"))


def crossing_phrases(spark, sf_dir) -> DataFrame:
    """Phrases that run over a page break: the end of one chunk and the start of the next."""
    pairs = ch.next_page_pairs(chunks(spark, sf_dir))
    phrase = F.trim(F.concat_ws(" ", F.right("text_a", F.lit(60)), F.left("text_b", F.lit(60))))
    return pairs.select("doc_id", F.lit("section_9_crossing").alias("section_key"), phrase.alias("phrase"))
