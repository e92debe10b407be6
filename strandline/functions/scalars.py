"""Scalar and array functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty, all-zero or unequally long vectors, null where one is null."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0))


def cosine_shorter(a: Column, b: Column) -> Column:
    """Cosine similarity over as many dimensions as the shorter vector has; 0 where a norm is."""
    n = F.least(F.size(a), F.size(b))
    return cosine(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters a-z and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def softplus(x: Column) -> Column:
    return F.when(x > 20, x).otherwise(F.log1p(F.exp(x)))


def association_weight(n: Column) -> Column:
    """Grows from 0 towards 1 with the number of co-activations."""
    return 1 - F.exp(-n / 5)


def bayes(prior: Column, evidence: Column) -> Column:
    """Confidence after evidence, held between 0.025 and 0.975."""
    both = prior * evidence
    return 0.95 * both / F.greatest(both + (1 - prior) * (1 - evidence), F.lit(1e-9)) + 0.025


def evidence(score: Column) -> Column:
    """How strongly a recall's score speaks for what was recalled."""
    return F.when(score >= 0.8, 0.8).when(score >= 0.5, 0.65).otherwise(0.55)


def base_activation(count: Column, age_days: Column, decay: float = 0.5) -> Column:
    """Activation that grows with uses and fades with age; a minute is the least age."""
    n = count + 1
    return F.log(n + 1) - decay * F.log(F.greatest(age_days, F.lit(1 / 1440)) / (n + 1))


def retention(count: Column, spacing_days: Column, days: Column) -> Column:
    """What is left of a memory after some days; uses, and space between them, make it last."""
    stability = F.least(F.greatest(20 * F.log(count) * (1 + 0.5 * F.tanh(spacing_days / 7)), F.lit(14.0)), F.lit(365.0))
    return F.greatest(F.lit(0.05), F.exp(-days / stability))


def composite(cos: Column, fts: Column, activation: Column, hebbian: Column, confidence: Column, weights: tuple[float, float, float]) -> Column:
    """Content match times use times confidence; ``weights`` are those of vector, text and association."""
    vector, text, link = weights
    return (vector * cos + text * F.tanh(fts)) * softplus(activation + link * hebbian) / (1 + softplus(F.lit(0.0))) * confidence


#: Weights of vector and text search by mode (fixed values).
MODES = {"semantic": (1.0, 0.0), "keyword": (0.0, 1.0), "hybrid": (0.7, 0.3)}


def uuid5(namespace: str | Column, name: Column) -> Column:
    """Version-5 UUID of a name, by SHA-1 of the namespace's bytes and the name."""
    space = F.lit(namespace) if isinstance(namespace, str) else namespace
    h = F.sha1(F.concat(F.unhex(F.translate(space, "-", "")), name.cast("binary")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def held_out(key: Column, percent: int = 20) -> Column:
    """Whether SHA-256 of the key, as a number, modulo 100 is under ``percent``; digits are folded one by one."""
    digits = F.transform(F.split(F.sha2(key, 256), ""), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda m, d: (m * 16 + d) % 100) < percent


def tags_of(text: Column) -> tuple[Column, Column]:
    """A leading ``[a,b]`` as lower-case tags, and the rest."""
    inner = F.regexp_extract(text, r"^\[([^\]]*)\]\s*", 1)
    tags = F.filter(F.transform(F.split(inner, ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return tags, F.regexp_replace(text, r"^\[[^\]]*\]\s*", "")


def linear(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the scores of single rules; without weights only that of association counts."""
    weights = {"hebbian": 1.0} if weights is None else weights
    return sum((score * weights.get(name, 0.0) for name, score in parts.items()), F.lit(0.0))


def direction(m_given_x: Column, m: Column, x_given_m: Column, x: Column) -> Column:
    """PMI(m|x) - PMI(x|m), each by mean log-probability of a token; texts without tokens have mean 0."""
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, p: s + p.cast("double")) / F.size(a)).otherwise(0.0)
    return (mean(m_given_x) - mean(m)) - (mean(x_given_m) - mean(x))
