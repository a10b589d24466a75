"""Benchmark scores, comparisons of runs and languages, leaderboards, and metric resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom

def latest(df: DataFrame, key: list[str], pos: str) -> DataFrame:
    """The last row of each key, as a keyed store keeps it."""
    names = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*names), F.col(pos)).alias("__row")).select(*key, "__row.*")


def accuracies(df: DataFrame, by: list[str], ok: str = "is_correct", predicted: str = "predicted_answer") -> DataFrame:
    """standard: of rows with a prediction; strict: of all rows; percent, 0 where there are none."""
    hit = F.count_if(F.col(ok))
    pct = lambda n: F.round(F.coalesce(100 * hit / F.nullif(n, F.lit(0)), F.lit(0.0)), 6)
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count(predicted).alias("valid"), hit.alias("correct"), pct(F.count(predicted)).alias("accuracy_standard"), pct(F.count("*")).alias("accuracy_strict"))


def subject_accuracy(df: DataFrame, subject: str, output: str = "model_raw_output", ok: str = "is_correct", predicted: str = "predicted_answer") -> DataFrame:
    kept = df.where(~(F.coalesce(F.col(output), F.lit("")).startswith("SKIPPED") | F.coalesce(F.col(output), F.lit("")).startswith("ERROR")))
    return accuracies(kept, [subject], ok, predicted).select(subject, "total", "valid", "correct", F.col("accuracy_standard").alias("accuracy"))


def failure_kind(truth: Column, predicted: Column) -> Column:
    return F.when(predicted.isNull(), "extraction_failed").when(predicted == truth, "correct").otherwise("incorrect_answer")


def reextraction(df: DataFrame, by: str, old: str, new: str, truth: str, falsy_zero: bool = False) -> DataFrame:
    """Changed, improved and degraded answers per dataset and in all. falsy_zero: a stored 0 counts as absent."""
    stored = F.when(F.col(old) == 0, None).otherwise(F.col(old)) if falsy_zero else F.col(old)
    was, now = F.coalesce(stored == F.col(truth), F.lit(False)), F.coalesce(F.col(new) == F.col(truth), F.lit(False))
    return df.select(by, was.alias("was"), now.alias("now"), (~stored.eqNullSafe(F.col(new))).alias("changed")).rollup(by).agg(
        F.count("*").alias("total"), F.count_if("changed").alias("changed"), F.count_if(F.expr("now and not was")).alias("improved"), F.count_if(F.expr("was and not now")).alias("degraded")
    )


def gap_split(a: DataFrame, b: DataFrame, key: str, ok: str = "is_correct", pos: str = "pos") -> DataFrame:
    """key, kind: right only in a (gap), only in b (reverse_gap) or in both; wrong in both is left out."""
    left = latest(a, [key], pos).select(F.col(key), F.col(ok).alias("__a"))
    right = latest(b, [key], pos).select(F.col(key), F.col(ok).alias("__b"))
    kind = F.when(F.expr("__a and not __b"), "gap").when(F.expr("__b and not __a"), "reverse_gap").when(F.expr("__a and __b"), "both_correct")
    return left.join(right, key).select(key, kind.alias("kind")).where("kind is not null")


def common_ids(*frames: DataFrame, key: str = "id") -> DataFrame:
    out = frames[0].select(key).distinct()
    for f in frames[1:]:
        out = out.join(f.select(key), key, "left_semi")
    return out


def side_by_side(ids: DataFrame, sources: dict[str, DataFrame], key: str = "id", pos: str = "pos") -> DataFrame:
    """For each id the answer and correctness of each source (absent: 'Not found', false), and the truth of the first that has it."""
    out, truths = ids.select(key).distinct(), []
    for name, f in sources.items():
        one = latest(f, [key], pos).select(key, F.col("predicted_answer").alias(f"{name}_answer"), F.col("is_correct").alias(f"{name}_correct"), F.col("ground_truth").alias(f"__{name}"), F.lit(True).alias(f"__has_{name}"))
        out = out.join(one, key, "left")
        truths.append(f"__{name}")
    told = [F.when(F.col(f"__has_{n}").isNull(), "Not found").otherwise(F.col(f"{n}_answer")).alias(f"{n}_answer") for n in sources]
    right = [F.coalesce(f"{n}_correct", F.lit(False)).alias(f"{n}_correct") for n in sources]
    return out.select(key, F.coalesce(*truths).alias("ground_truth"), *told, *right)


def agreement(table: DataFrame, a: str, b: str) -> DataFrame:
    """How often two sources answer alike; two missing predictions agree, 'Not found' rows don't count."""
    present = table.where(~F.col(f"{a}_answer").eqNullSafe(F.lit("Not found")) & ~F.col(f"{b}_answer").eqNullSafe(F.lit("Not found")))
    same = F.count_if(F.col(f"{a}_answer").eqNullSafe(F.col(f"{b}_answer")))
    return present.agg(F.count("*").alias("total"), same.alias("agreeing"), F.round(100 * same / F.count("*"), 2).alias("rate"))


def partition_ids(df: DataFrame, key: str = "id", ok: str = "is_correct") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(ok)).select(key), df.where(~F.col(ok)).select(key)


def unprocessed(wanted: DataFrame, done: DataFrame, key: str = "id", words: DataFrame | None = None, bits: int = bloom.BITS) -> DataFrame:
    """Resume: what has not been processed yet. With a Bloom filter of the done keys (of bloom.build, kept with them; it may have more keys, not fewer)
    only rows whose key may be done are joined, all others are new without a shuffle."""
    new, rest = (None, wanted) if words is None else bloom.split(wanted, key, words, bits)
    left = rest.join(done.select(key).distinct(), key, "left_anti").select(*wanted.columns)
    return left if new is None else new.unionByName(left)


def unfinished(wanted: DataFrame, done: DataFrame, key: str, gold: str, completed: str, words: DataFrame | None = None, bits: int = bloom.BITS) -> DataFrame:
    """Unprocessed rows and such with fewer completed than wanted; a Bloom filter as in unprocessed."""
    new, rest = (None, wanted) if words is None else bloom.split(wanted, key, words, bits)
    n = done.groupBy(key).agg(F.max(completed).alias("__done"))
    left = rest.join(n, key, "left").where(F.coalesce("__done", F.lit(-1)) < F.size(gold)).select(*wanted.columns)
    return left if new is None else new.where(F.size(gold) > -1).unionByName(left)


def _mean(x: Column) -> Column:
    """The mean of values of six places by an exact sum: the order of the rows doesn't count."""
    return F.sum(x.cast("decimal(18,6)")).cast("double") / F.count(x)


def language_comparison(summaries: DataFrame, benchmark: str, lang: str, metric: str) -> DataFrame:
    """Means per benchmark of EN and KO and their difference."""
    en, ko = (_mean(F.when(F.col(lang) == x, F.col(metric))) for x in ("en", "ko"))
    return summaries.groupBy(benchmark).agg(en.alias("en"), ko.alias("ko"), (en - ko).alias("difference"), ((en + ko) / 2).alias("combined"))


def spread(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    m = F.col(metric)
    return df.groupBy(*by).agg(F.round(F.avg(m), 6).alias("mean"), F.round(F.var_pop(m), 6).alias("variance"), F.round(F.stddev_pop(m), 6).alias("std"), F.min(m).alias("min"), F.max(m).alias("max"), F.round(F.max(m) - F.min(m), 6).alias("range"))


def score_range(df: DataFrame, metric: str) -> DataFrame:
    """all_*: missing metrics count as 0; valid_*: only those there are."""
    z = F.coalesce(F.col(metric), F.lit(0.0))
    return df.agg(F.round(F.max(z), 6).alias("all_max"), F.round(F.min(z), 6).alias("all_min"), F.round(F.avg(z), 6).alias("all_mean"), F.round(F.avg(metric), 6).alias("valid_mean"), F.round(F.max(metric) - F.min(metric), 6).alias("valid_gap"))


def _all() -> Window:
    return Window.partitionBy(F.lit(0))


def ranked(df: DataFrame, metric: str, tie: str, best: bool = True) -> DataFrame:
    """rank by a metric; ties by name. One row a model: small by nature."""
    return df.withColumn("rank", F.row_number().over(_all().orderBy(F.desc(metric) if best else F.asc(metric), tie)))


def top_and_worst(models: DataFrame, metric: str, tie: str, k: int = 3) -> DataFrame:
    """side, place, rank: the k best, and the k worst with the lowest first and ranks from the end."""
    valid = models.where(F.col(metric).isNotNull()).withColumn("__n", F.count("*").over(_all()))
    low, high = F.row_number().over(_all().orderBy(F.asc(metric), F.desc(tie))), F.row_number().over(_all().orderBy(F.desc(metric), tie))
    both = valid.withColumns({"__low": low, "__high": high})
    top = both.where(F.col("__high") <= k).select(F.lit("top").alias("side"), F.col("__high").alias("place"), F.col("__high").cast("long").alias("rank"), tie, metric)
    worst = both.where(F.col("__low") <= k).select(F.lit("worst").alias("side"), F.col("__low").alias("place"), (F.col("__n") - F.col("__low") + 1).alias("rank"), tie, metric)
    return top.unionByName(worst)


def percentile_level(models: DataFrame, metric: str) -> DataFrame:
    """Percent of models strictly below, level, and distance from the mean."""
    below = 100 * (F.rank().over(_all().orderBy(metric)) - 1) / F.count("*").over(_all())
    out = models.withColumn("percentile", F.round(below, 6))
    return out.withColumns({"level": F.when(F.col("percentile") >= 66.7, "high").when(F.col("percentile") >= 33.3, "mid").otherwise("low"), "from_mean": F.round(F.col(metric) - F.avg(metric).over(_all()), 6)})


def subject_extremes(df: DataFrame, model: str, subject: str, metric: str, k: int = 3) -> DataFrame:
    """The k strongest and weakest subjects of each model; ties by name."""
    w = Window.partitionBy(model)
    high, low = F.row_number().over(w.orderBy(F.desc(metric), subject)), F.row_number().over(w.orderBy(F.asc(metric), subject))
    both = df.withColumns({"__high": high, "__low": low})
    return both.where(F.col("__high") <= k).select(model, subject, F.lit("strong").alias("side"), F.col("__high").alias("place")).union(both.where(F.col("__low") <= k).select(model, subject, F.lit("weak"), F.col("__low")))


def leaderboard(df: DataFrame, lang: str, model: str, metric: str) -> DataFrame:
    """Per language the models by falling metric (ties by name), and whether one is the best."""
    rank = F.row_number().over(Window.partitionBy(lang).orderBy(F.desc(metric), model))
    return df.withColumn("rank", rank).withColumn("is_best", F.col("rank") == 1)


def with_metric(df: DataFrame, metric: str) -> DataFrame:
    """Rows whose metric is a number."""
    return df.where(F.col(metric).cast("string").try_cast("double").isNotNull())


def task_means(df: DataFrame, model: str, task: str, metric: str, tasks: list[str]) -> DataFrame:
    """model, mean over the tasks (absent: 0), rank."""
    table = task_table(df, model, task, metric, tasks)
    mean = sum((F.col(f"`{t}`").cast("decimal(18,6)") for t in tasks), F.lit(0).cast("decimal(18,6)")) / len(tasks)
    return ranked(table.select(model, F.round(mean.cast("double"), 6).alias("mean")), "mean", model)


def summary_table(df: DataFrame, model: str, task: str, metric: str, tasks: list[str], places: int = 3) -> DataFrame:
    """Models by tasks as text, N/A where there is no result."""
    shown = df.groupBy(model).pivot(task, tasks).agg(F.first(F.when(F.col(metric).isNotNull(), F.format_string(f"%.{places}f", metric)), True))
    return shown.na.fill("N/A", subset=tasks)


def best_per_task(df: DataFrame, task: str, model: str, metric: str) -> DataFrame:
    return df.groupBy(task).agg(F.min_by(model, F.struct(-F.col(metric), F.col(model))).alias("best"), F.max(metric).alias("score"))


def task_table(df: DataFrame, model: str, task: str, metric: str | list[str], tasks: list[str], missing=0.0) -> DataFrame:
    """Models by tasks, absent results as `missing`. metric: a column, or a list of which the first that a row has counts."""
    value = F.coalesce(*(F.col(m) for m in ([metric] if isinstance(metric, str) else metric)))
    return df.groupBy(model).pivot(task, tasks).agg(F.first(value, True)).na.fill(missing, subset=tasks)


def difficulty(df: DataFrame, task: str, metric: str) -> DataFrame:
    m = _mean(F.col(metric))
    return df.groupBy(task).agg(F.round(m, 6).alias("mean"), F.when(m > 0.8, "Easy").when(m > 0.5, "Medium").otherwise("Hard").alias("tier"))


def cohorts(df: DataFrame, task: str, model: str, metric: str, mark: str = "-ToW") -> DataFrame:
    """Per task the means of marked models and the rest, their difference and percent change; tasks without one side are left out."""
    a, b = (_mean(F.when(of, F.col(metric))) for of in (F.contains(F.col(model), F.lit(mark)), ~F.contains(F.col(model), F.lit(mark))))
    out = df.groupBy(task).agg(a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    return out.select(task, F.col("a").alias("marked"), F.col("b").alias("base"), (F.col("a") - F.col("b")).alias("difference"), F.when(F.col("b") > 0, 100 * (F.col("a") - F.col("b")) / F.col("b")).otherwise(0.0).alias("change_pct"))


#: Keys of a result that are no scores.
NO_SCORES = ("alias", "num_fewshot", "stderr", "stderr_norm", "alias_norm", "num_examples", "version", "task_hash")


def resolve_metric(df: DataFrame, key: str, results: str, task: str, priority: list[str], unit_range: bool = False, first_key: bool = False, excluded: tuple[str, ...] = NO_SCORES) -> DataFrame:
    """df (key, results map<string, map<string, double>>) -> key, task_key, metric, value.

    The task's entry is the exact key, else the first in the file that contains it or is contained in it, else (first_key) the
    first of all; its metric the first of `priority`, else the first in the file that is no measure of an error and not
    excluded (unit_range: of 0 to 1). Without any, nulls. Maps keep the order of the file.
    """
    keys = F.map_keys(results)
    pick = lambda of: F.try_element_at(F.filter(keys, of), F.lit(1))
    entry = F.coalesce(pick(lambda k: k == task), pick(lambda k: F.contains(k, F.lit(task)) | F.contains(F.lit(task), k)), *([F.try_element_at(keys, F.lit(1))] if first_key else []))
    found = df.select(key, entry.alias("task_key"), F.try_element_at(results, entry).alias("m"))
    ok = lambda k: ~k.endswith("_stderr") & ~k.startswith("_") & ~k.isin(*excluded)
    value = lambda k: F.try_element_at(F.col("m"), k)
    fits = F.filter(F.map_keys("m"), lambda k: ok(k) & value(k).isNotNull() & (value(k).between(0, 1) if unit_range else F.lit(True)))
    listed = F.filter(F.array(*map(F.lit, priority)), lambda p: F.array_contains(F.map_keys("m"), p))
    metric = F.coalesce(F.try_element_at(listed, F.lit(1)), F.try_element_at(fits, F.lit(1)))
    return found.withColumn("metric", metric).select(key, "task_key", "metric", value(F.col("metric")).alias("value"))


#: What names of evaluation files contain, in the order in which it is looked for.
EVALUATIONS = ("ko_arc", "ko-arc", "arc", "kmmlu", "mmlu_prox", "mmlu-prox", "mmlu", "hrm8k", "gsm8k", "hellaswag", "piqa", "klue")


def detect_evaluation(name: str) -> str:
    """The kind of an evaluation file by its name; the first of the list that it contains."""
    return next((kind.replace("-", "_") for kind in EVALUATIONS if kind in name.lower()), "unknown")


def evaluation_kind(name: Column) -> Column:
    """detect_evaluation as a column."""
    return F.coalesce(*(F.when(F.contains(F.lower(name), F.lit(kind)), kind.replace("-", "_")) for kind in EVALUATIONS), F.lit("unknown"))


def markdown(rows: list[dict], title: str) -> str:
    """A small report of collected rows."""
    if not rows:
        return f"# {title}\n\n(no rows)\n"
    names = list(rows[0])
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows), ""])


def report_lines(df: DataFrame, model: str, task: str, metric: str, tasks: list[str]) -> DataFrame:
    """section, place, line: the parts of a report on models and tasks: an overview, the best model of each task, the ranking, the difficulty."""
    shown = lambda x: F.format_string("%.4f", x)
    table = df.where(F.col(task).isin(*tasks))
    count = table.agg(F.countDistinct(model).alias("n"))
    overview = count.select(F.lit("overview").alias("section"), F.lit(1).alias("place"), F.concat(F.col("n").cast("string"), F.lit(f" models, {len(tasks)} tasks, "), (F.col("n") * len(tasks)).cast("string"), F.lit(" evaluations")).alias("line"))
    order = F.element_at(F.create_map(*(F.lit(x) for i, t in enumerate(tasks) for x in (t, i + 1))), F.col(task))
    best = best_per_task(table, task, model, metric).select(F.lit("best").alias("section"), order.alias("place"), F.concat(task, F.lit(": "), "best", F.lit(" ("), shown("score"), F.lit(")")).alias("line"))
    ranking = task_means(table, model, task, metric, tasks).select(F.lit("ranking").alias("section"), F.col("rank").alias("place"), F.concat(model, F.lit(" (average "), shown("mean"), F.lit(")")).alias("line"))
    hard = ranked(difficulty(table, task, metric), "mean", task).select(F.lit("difficulty").alias("section"), F.col("rank").alias("place"), F.concat(task, F.lit(": "), shown("mean"), F.lit(" ("), "tier", F.lit(")")).alias("line"))
    return overview.unionByName(best).unionByName(ranking).unionByName(hard)


def report_text(lines: list[dict], title: str) -> str:
    """The lines of a report (section, place, line) as Markdown."""
    out = [f"# {title}"]
    for section in dict.fromkeys(r["section"] for r in lines):
        out += ["", f"## {section.capitalize()}", *(f"{r['place']}. {r['line']}" for r in sorted((r for r in lines if r["section"] == section), key=lambda r: r["place"]))]
    return "\n".join([*out, ""])
