"""Tasks and models by name, and a runner that goes on when a task fails (API01-08, ORC01-02)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Evaluate = Callable[[SparkSession, DataFrame], float]
STATUS = "model string, task string, category string, score double, status string, error string"


@dataclass(frozen=True)
class Task:
    """evaluate: from the embeddings of a model (id, vec and what else the task needs) to its main score."""

    name: str
    category: str
    evaluate: Evaluate
    main_score: str = "main_score"
    splits: tuple[str, ...] = ("test",)
    languages: tuple[str, ...] = ()
    default: bool = True


@dataclass
class Registry:
    """Tasks in the order in which they were added."""

    tasks: dict[str, Task] = field(default_factory=dict)

    def add(self, task: Task) -> Task:
        """The same task again changes nothing; another one of its name is refused."""
        if self.tasks.setdefault(task.name, task) != task:
            raise ValueError(f"another task is named {task.name}")
        return task

    def get(self, name: str) -> Task:
        if name not in self.tasks:
            raise KeyError(f"no task {name}; there are {', '.join(self.tasks) or 'none'}")
        return self.tasks[name]

    def select(self, names: Sequence[str] | None = None, categories: Sequence[str] | None = None) -> list[Task]:
        """Tasks by name or by category, not both, each once and in the order asked for; without either the default ones."""
        if names is not None and categories is not None:
            raise ValueError("give names or categories, not both")
        if names is not None:
            return [self.get(n) for n in dict.fromkeys(names)]
        if categories is None:
            return [t for t in self.tasks.values() if t.default]
        if unknown := set(categories) - {t.category for t in self.tasks.values()}:
            raise KeyError(f"no category {', '.join(sorted(unknown))}")
        return [t for c in dict.fromkeys(categories) for t in self.tasks.values() if t.category == c]

    def described(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, t.category, t.main_score, list(t.splits), list(t.languages), t.default) for t in self.tasks.values()]
        return spark.createDataFrame(rows, "task string, category string, main_score string, splits array<string>, languages array<string>, is_default boolean")


def upserted(models: DataFrame, new: DataFrame, key: str = "model") -> DataFrame:
    """``models`` with the rows of ``new`` in place of those of the same key; doing so again changes nothing."""
    return models.join(new.select(key).distinct(), key, "left_anti").select(*models.columns).unionByName(new.select(*models.columns).dropDuplicates([key]))


def run(spark: SparkSession, model: str, embeddings: DataFrame, tasks: Iterable[Task], done: DataFrame | None = None, raise_error: bool = False) -> DataFrame:
    """A row for each task: its score, or the error that it failed with. Tasks that ``done`` (of the same form) has as "ok" for this model are "kept" with their score."""
    before = {} if done is None else {r.task: r.score for r in done.where((F.col("model") == model) & (F.col("status") == "ok")).select("task", "score").collect()}
    rows = []
    for t in tasks:
        if t.name in before:
            rows.append((model, t.name, t.category, before[t.name], "kept", None))
            continue
        try:
            rows.append((model, t.name, t.category, float(t.evaluate(spark, embeddings)), "ok", None))
        except Exception as e:
            if raise_error:
                raise
            rows.append((model, t.name, t.category, None, "failed", f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(rows, STATUS)


def complete(status: DataFrame, needed: int) -> DataFrame:
    """model, n_done, is_complete: models with ``needed`` scores or more, counted from scores and not from exit codes."""
    return status.where(F.col("score").isNotNull()).groupBy("model").agg(F.countDistinct("task").alias("n_done")).withColumn("is_complete", F.col("n_done") >= needed)
