"""Scoring distinct prompts with a user-supplied function, the one Python step of an audit."""

import random
import time
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secondlook import fixed
from secondlook.session import TEXT_CODEC, remove_folder, staged_path

Scorer = Callable[[list[str]], list[str]]

#: Requests of one staged file, and files that one task of a round answers.
FILE_REQUESTS = 4096
TASK_FILES = 4

ANSWER_FIELDS = [
    T.StructField("raw_response", T.StringType()),
    T.StructField("latency_ms", T.LongType()),
    T.StructField("error", T.StringType()),
]


class ScorerError(Exception):
    """A failed call; ``status`` is the service's HTTP-style status code, if there is one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message, status)
        self.message = message
        self.status = status

    def __str__(self) -> str:
        return self.message


def is_transient(problem: Exception) -> bool:
    """Worth another try: timeouts, connection trouble, overload and server-side failures."""
    if isinstance(problem, ScorerError):
        status = problem.status
        return status is not None and (500 <= status <= 599 or status in fixed.RETRYABLE_STATUS)
    return isinstance(problem, (TimeoutError, ConnectionError))


def call_with_retry(
    scorer: Scorer,
    prompts: list[str],
    max_retries: int = fixed.MAX_RETRIES,
    base_seconds: float = fixed.RETRY_BASE_SECONDS,
) -> list[str]:
    """Call the scorer, waiting longer after each transient failure; other failures pass through."""
    attempt = 0
    while True:
        try:
            answers = list(scorer(prompts))
            if len(answers) != len(prompts):
                raise ScorerError(f"scorer gave {len(answers)} answers to {len(prompts)} prompts")
            return answers
        except Exception as problem:
            attempt += 1
            if attempt >= max_retries or not is_transient(problem):
                raise
            jitter = random.uniform(0, fixed.RETRY_JITTER_SECONDS) if base_seconds else 0.0
            time.sleep(base_seconds * 2 ** (attempt - 1) + jitter)


def score_prompts(
    requests: DataFrame,
    make_scorer: Callable[[], Scorer],
    concurrency: int | None = None,
    batch_size: int = 32,
    max_retries: int = fixed.MAX_RETRIES,
    base_seconds: float = fixed.RETRY_BASE_SECONDS,
    file_requests: int = FILE_REQUESTS,
    task_files: int = TASK_FILES,
) -> DataFrame:
    """Answer every request: ``prompt`` is replaced by (raw_response, latency_ms, error).

    All other columns pass through as Arrow data, untouched; a null prompt stays unanswered.
    ``make_scorer`` runs once per task, so connections and models are set up there. With
    ``concurrency`` at most that many tasks call at once, and none reads more than ``file_requests`` times
    ``task_files`` requests, however many there are: the requests are staged in files of bounded size and answered at once, in
    rounds of that many tasks; answered rounds are kept. A batch waits and tries again while its failure is
    transient; a service that stays overloaded gets no more calls for it. After any other failure the batch is
    halved, so one bad prompt yields one row with ``error`` and never a failed job.
    """

    def answer_batch(scorer: Scorer, prompts: list[str]):
        if not prompts:
            return []
        try:
            return [(a, None) for a in call_with_retry(scorer, prompts, max_retries, base_seconds)]
        except Exception as problem:
            if len(prompts) == 1 or is_transient(problem):
                return [(None, str(problem))] * len(prompts)
        half = len(prompts) // 2
        return answer_batch(scorer, prompts[:half]) + answer_batch(scorer, prompts[half:])

    def answer_part(scorer: Scorer, part: pa.RecordBatch) -> pa.RecordBatch:
        prompts = part.column("prompt").to_pylist()
        asked = [i for i, p in enumerate(prompts) if p is not None]
        begun = time.monotonic()
        answers = answer_batch(scorer, [prompts[i] for i in asked])
        each = int((time.monotonic() - begun) * 1000) // max(len(asked), 1)
        answered: list = [(None, None, None)] * len(prompts)
        for i, (text, error) in zip(asked, answers):
            answered[i] = (text, each, error)
        texts, spent, errors = zip(*answered)
        columns = [part.column(name) for name in kept] + [
            pa.array(texts, pa.string()), pa.array(spent, pa.int64()), pa.array(errors, pa.string())
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                yield answer_part(scorer, batch.slice(start, batch_size))

    kept = [name for name in requests.columns if name != "prompt"]
    schema = T.StructType([requests.schema[name] for name in kept] + ANSWER_FIELDS)
    if concurrency is None:
        return requests.mapInArrow(score, schema)
    if requests.isStreaming:  # its micro-batches are the rounds
        return requests.repartition(concurrency, F.col("prompt_hash")).mapInArrow(score, schema)
    spark = requests.sparkSession
    asked, answers = staged_path(spark, "requests"), staged_path(spark, "answers")
    requests.write.options(maxRecordsPerFile=file_requests, compression=TEXT_CODEC).parquet(asked)
    files = sorted(unquote(f) for f in spark.read.schema(requests.schema).parquet(asked).inputFiles())
    size = concurrency * task_files
    for start in range(0, max(len(files), 1), size):
        chosen = files[start : start + size]
        part = spark.read.schema(requests.schema).parquet(*(chosen or [asked]))
        # A full round has files enough for all tasks; a smaller one is dealt out row by row.
        full = len(chosen) == size
        dealt = part.coalesce(concurrency) if full else part.repartition(concurrency, F.col("prompt_hash"))
        dealt.mapInArrow(score, schema).write.mode("append").parquet(answers)
    remove_folder(spark, asked)
    return spark.read.schema(schema).parquet(answers)
