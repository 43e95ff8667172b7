"""Asking a text generator from inside the tasks: tries, pacing, and answers that are kept.

A writer is any function from a batch of prompts to a batch of texts. Around it stand
three things that a remote one needs. *Tries*: a call that says it is overloaded is
repeated after growing waits, an answer that is not of use is asked for again, and what
still fails becomes a row with its error. *Pacing*: each task has a token bucket, so
tasks times rate is the load. *Answers*: they go to a table keyed by the digest of the
prompt, and on the way there to a journal that a task writes after every batch. A
repeated task or a repeated run reads both first, so a prompt is not asked twice; only
the batch in which a task was lost is.
"""

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundworks.sources import versions
from moundworks.sources.store import _file_system, open_folder, qualified, ship_package

Writer = Callable[[pd.Series], pd.Series]

# --- fixed values: tries, waits and messages --------------------------------
TRIES, FIRST_WAIT, WAIT_GROWTH = 3, 5.0, 2.0
GAVE_UP = "max_retries_exceeded"
# ------------------------------------------------------------------------------
ANSWERS = "prompt_digest string, response string, error string, tries int"


class Overloaded(Exception):
    """Raised by a writer that may succeed if it is asked again later."""


@dataclass(frozen=True)
class Manners:
    """How a writer is asked: tries per prompt, waits between them, prompts a second in each
    task (None: no limit), and prompts in a call. ``useful`` says whether a text is an answer."""

    tries: int = TRIES
    first_wait: float = FIRST_WAIT
    growth: float = WAIT_GROWTH
    per_second: float | None = None
    batch: int = 32
    useful: Callable[[str], bool] | None = None
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic


def is_json_object(text: str) -> bool:
    """For ``Manners.useful``: whether the text is one JSON object."""
    try:
        return isinstance(json.loads(text), dict)
    except (TypeError, ValueError):
        return False


class TokenBucket:
    """Lets ``rate`` prompts a second through, a second's worth at once."""

    def __init__(self, manners: Manners):
        self.rate, self.sleep, self.clock = manners.per_second, manners.sleep, manners.clock
        self.tokens, self.at = max(self.rate or 0.0, 1.0), manners.clock()

    def take(self, n: int) -> None:
        if self.rate is None:
            return
        now = self.clock()
        self.tokens = min(max(self.rate, 1.0), self.tokens + (now - self.at) * self.rate) - n
        self.at = now
        if self.tokens < 0:  # the debt is slept off, and paid when the clock is read next
            self.sleep(-self.tokens / self.rate)


def ask(writer: Writer, prompts: list[str | None], manners: Manners, bucket: TokenBucket | None = None) -> list[tuple[str | None, str | None, int]]:
    """(text, error, tries) of each prompt. A null prompt is not asked and has neither text nor error.

    An overloaded call is tried again as it is; a call that fails otherwise is asked prompt
    by prompt, so that one bad prompt costs no other its answer. A text that is of no use
    is asked for again, and the last one is kept.
    """
    bucket = bucket or TokenBucket(manners)
    found: list[tuple[str | None, str | None, int]] = [(None, None, 0)] * len(prompts)
    waiting = [i for i, p in enumerate(prompts) if p is not None]
    single = len(waiting) == 1
    for k in range(1, manners.tries + 1):
        if not waiting:
            break
        bucket.take(len(waiting))
        try:
            texts = list(writer(pd.Series([prompts[i] for i in waiting])))
            if len(texts) != len(waiting):
                raise ValueError(f"{len(texts)} texts for {len(waiting)} prompts")
        except Overloaded:
            for i in waiting:
                found[i] = (None, GAVE_UP, k)
            if k < manners.tries:
                manners.sleep(manners.first_wait * manners.growth ** (k - 1))
            continue
        except Exception as e:  # noqa: BLE001  whatever the writer raises becomes the row's error
            if single:
                found[waiting[0]] = (None, f"{type(e).__name__}: {e}", k)
                break
            for i in waiting:
                text, error, tries = ask(writer, [prompts[i]], manners, bucket)[0]
                found[i] = (text, error, k + tries)
            break
        for i, text in zip(waiting, texts):
            found[i] = (text, None, k)
        waiting = [i for i, text in zip(waiting, texts) if manners.useful is not None and not manners.useful(text)]
        single = len(waiting) == 1
    return found


def generate(prompts: DataFrame, writer: Writer | None = None, prompt: str = "prompt", out: str = "response", default: str = "template",
             manners: Manners = Manners()) -> DataFrame:
    """``prompts`` with a text in ``out``, and in ``{out}_error`` why there is none.

    Without a writer the text is the column ``default``, such as a template narrative
    as JSON. Nothing is kept: where an answer costs something, use ``generate_once``.
    """
    if writer is None:
        return prompts.withColumns({out: F.col(default), f"{out}_error": F.lit(None).cast("string")})
    ship_package(prompts.sparkSession)
    schema = T.StructType([*prompts.schema.fields, T.StructField(out, T.StringType()), T.StructField(f"{out}_error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(manners)
        for whole in batches:
            for at in range(0, len(whole), manners.batch):
                part = whole.iloc[at:at + manners.batch]
                texts, errors, _ = zip(*ask(writer, [None if pd.isna(p) else p for p in part[prompt]], manners, bucket))
                yield part.assign(**{out: list(texts), f"{out}_error": list(errors)})

    return prompts.mapInPandas(run, schema)


def _journal(path: str) -> str:
    return f"{path}/journal"


def _absorb(spark, path: str) -> None:
    """Move what the journals hold into the table of answers, and drop them."""
    fs, folder = _file_system(spark, _journal(path))
    if not fs.exists(folder):
        return
    try:
        told = spark.read.schema(ANSWERS).json(f"{_journal(path)}/*/*/*.json").filter("prompt_digest IS NOT NULL")
        versions.upsert(told, path, _newer)
    except AnalysisException:  # a job that stopped before its first batch
        pass
    fs.delete(folder, True)


def _newer(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per prompt: an answer before an error, the new batch before the old one."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    best = F.max_by(F.struct("response", "error", "tries"), F.struct(F.col("error").isNull(), "_batch", "tries")).alias("_a")
    return both.groupBy("prompt_digest").agg(best).select("prompt_digest", "_a.*")


def answers(prompts: DataFrame, writer: Writer, path: str, prompt: str = "prompt", manners: Manners = Manners(), again: bool = True) -> DataFrame:
    """Ask for every prompt that ``path`` has no answer to, and return the table of answers.

    Equal prompts are asked once. Those that failed in an earlier call are asked again
    if ``again``. Rows: prompt_digest, response, error, tries.
    """
    spark = prompts.sparkSession
    ship_package(spark)
    path = qualified(spark, path)
    if versions.current(spark, path) is None:
        versions.replace(spark.createDataFrame([], ANSWERS), path, ["prompt_digest"])
    _absorb(spark, path)
    known = versions.read(spark, path)
    done = known if not again else known.filter("error IS NULL")
    wanted = prompts.filter(F.col(prompt).isNotNull()).select(F.sha2(prompt, 256).alias("prompt_digest"), F.col(prompt).alias("prompt"))
    todo = wanted.dropDuplicates(["prompt_digest"]).join(done.select("prompt_digest"), "prompt_digest", "left_anti")
    job = f"{_journal(path)}/{uuid.uuid4().hex}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_folder(f"{job}/{TaskContext.get().partitionId()}")
        store.create_dir(root, recursive=True)
        told = _told(store, root)  # by an earlier attempt at this task
        bucket = TokenBucket(manners)
        for whole in batches:
            for at in range(0, len(whole), manners.batch):
                part = whole.iloc[at:at + manners.batch]
                fresh = part[~part["prompt_digest"].isin(told.keys())]
                if len(fresh):
                    rows = [{"prompt_digest": d, "response": t, "error": e, "tries": k}
                            for d, (t, e, k) in zip(fresh["prompt_digest"], ask(writer, list(fresh["prompt"]), manners, bucket))]
                    with store.open_output_stream(f"{root}/{uuid.uuid4().hex}.json") as f:
                        f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
                    told.update({r["prompt_digest"]: r for r in rows})
                yield pd.DataFrame([told[d] for d in part["prompt_digest"]])

    todo.mapInPandas(run, ANSWERS).write.format("noop").mode("overwrite").save()  # the journal has the answers
    _absorb(spark, path)
    return versions.read(spark, path)


def _told(store, root: str) -> dict[str, dict]:
    """Answers in a task's journal; a last line that was cut off is left out."""
    from pyarrow.fs import FileSelector
    found = {}
    for info in store.get_file_info(FileSelector(root, allow_not_found=True)):
        with store.open_input_stream(info.path) as f:
            for line in f.read().decode().split("\n")[:-1]:
                row = json.loads(line)
                found[row["prompt_digest"]] = row
    return found


def generate_once(prompts: DataFrame, writer: Writer, path: str, prompt: str = "prompt", out: str = "response", manners: Manners = Manners(),
                  again: bool = True) -> DataFrame:
    """``generate`` with the answers kept at ``path``: a prompt that has one is never asked again,
    in this call, after lost tasks, or in later calls."""
    table = answers(prompts, writer, path, prompt, manners, again)
    told = table.select(F.col("prompt_digest").alias("_digest"), F.col("response").alias(out), F.col("error").alias(f"{out}_error"))
    keyed = prompts.withColumn("_key", F.sha2(prompt, 256))
    return keyed.join(told, F.col("_key") == F.col("_digest"), "left").drop("_key", "_digest")
