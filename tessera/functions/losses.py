"""Losses over arrays of logits, as column expressions that large logits don't overflow."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label of a position that no loss counts.
IGNORED = -100


def let(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda would compute it again for every element."""
    return F.transform(F.array(value), use)[0]


def log_softmax(logits: Column) -> Column:
    """Each logit less the log of the sum of all exponentials, which is taken relative to the largest; null if empty."""

    def less(a: Column, most: Column) -> Column:
        total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - most))
        return let(most + F.log(total), lambda norm: F.transform(a, lambda x: x - norm))

    return F.when(F.size(logits) > 0, let(logits, lambda a: let(F.array_max(a), lambda most: less(a, most))))


def scaled(logits: Column, by: float) -> Column:
    return F.transform(logits, lambda x: x.cast("double") * by)


def kl_row(teacher: Column, student: Column, temperature: float) -> Column:
    """KL divergence of the teacher's distribution from the student's, both at a temperature. A teacher with more logits
    than the student is cut to the student's."""
    own = lambda c: log_softmax(scaled(c, 1 / temperature))
    t, s = own(F.slice(teacher, 1, F.size(student))), own(student)
    terms = F.zip_with(t, s, lambda a, b: F.when(F.exp(a) > 0, F.exp(a) * (a - b)).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)


def ce_row(logits: Column, label: Column) -> Column:
    """Cross entropy of one position; null where the label is ignored."""
    return F.when(label != IGNORED, -F.get(log_softmax(scaled(logits, 1.0)), label))


def distillation(kl: Column, ce: Column, label: Column, temperature: float, alpha: float) -> dict[str, Column]:
    """Aggregates over positions: kl (mean over labelled ones, times the temperature's square), ce, their mixture total, and
    how many count. Without a labelled position all are 0."""
    valid = label != IGNORED
    mean = lambda c: F.coalesce(F.avg(F.when(valid, c)), F.lit(0.0))
    k, c = mean(kl) * temperature**2, mean(ce)
    return {"kl": k, "ce": c, "total": alpha * k + (1 - alpha) * c, "n": F.count_if(valid)}
