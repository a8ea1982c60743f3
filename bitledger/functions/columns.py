"""Column expressions. All stay in the JVM: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitledger.functions import fixed_values as fixed


def round_half_up(value: Column, digits: int) -> Column:
    """Round at ``digits`` decimals with the one rule used everywhere: floor(x*10^n + 0.5).

    NaN, infinities and numbers too large to have such decimals pass unchanged.
    """
    scale = float(10**digits)
    value = value.cast("double")
    rounded = F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    # NaN counts as larger than any number.
    return F.when(F.abs(value) >= F.lit(2.0**52 / scale), value).otherwise(rounded)


def missing_if_nan(value: Column) -> Column:
    """NaN and null both mean "missing"; only null is kept so that means skip it."""
    return F.when(~F.isnan(value), value)


def path_basename(path: Column) -> Column:
    """Last segment of a path; trailing slashes do not count."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def name_tokens(name: Column) -> Column:
    """Lower-case parts of a model directory name; runs of ``-`` and ``_`` separate them."""
    return F.split(F.lower(name), "[-_]+")


def method_position(tokens: Column) -> Column:
    """Place of the first token that names a method, from 1; null without one."""
    places = [F.nullif(F.array_position(tokens, F.lit(t)), F.lit(0)) for t in fixed.METHOD_TOKENS]
    return F.least(*places)


def _method_code(tokens: Column, position: Column) -> Column:
    """Code of the method at ``position``, else ``unknown``."""
    token = F.get(tokens, position - F.lit(1))
    aliases = [spelling for spelling, code in fixed.METHOD_TOKENS.items() if spelling != code]
    return (
        F.when(position.isNull(), F.lit("unknown"))
        .when(token.isin(aliases), F.lit("smooth"))
        .otherwise(token)
    )


def _family(name: Column, tokens: Column, position: Column) -> Column:
    """Tokens ahead of the method; a name that starts with its method keeps its raw form."""
    n_tokens = F.coalesce(position - F.lit(1), F.size(tokens))
    family = F.array_join(F.slice(tokens, F.lit(1), n_tokens.cast("int")), "-")
    return F.when(position == 1, name).otherwise(family)


def family_and_method(name: Column) -> Column:
    """Both parts of a model directory name as a struct, from one pass over its tokens.

    The lambdas name the intermediate values. However often the struct's fields are used,
    or moved into filters by the planner, a name is split once per use and not once per step.
    """
    located = F.transform(
        F.array(name_tokens(name)), lambda t: F.struct(t.alias("t"), method_position(t).alias("at"))
    )
    parsed = F.transform(
        located,
        lambda p: F.struct(
            _family(name, p["t"], p["at"]).alias("model_family"),
            _method_code(p["t"], p["at"]).alias("method"),
        ),
    )
    return F.get(parsed, F.lit(0))


def model_scheme(name: Column) -> Column:
    """First ``w<n>a<m>`` as ``W<n>A<m>``; ``int4``/``int8`` anywhere mean W4A16/W8A16."""
    lower = F.lower(name)
    return (
        F.when(lower.rlike(r"w\d+a\d+"), F.upper(F.regexp_extract(lower, r"w\d+a\d+", 0)))
        .when(lower.contains("int4"), F.lit("W4A16"))
        .when(lower.contains("int8"), F.lit("W8A16"))
        .otherwise(F.lit("unknown"))
    )


def method_label(method: Column) -> Column:
    """Display name of a method code; codes without one pass through."""
    pairs = [F.lit(x) for pair in fixed.METHOD_LABELS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), method), method)


def method_scheme_label(label: Column, scheme: Column) -> Column:
    """``label (scheme)``; the label alone when the scheme is not known."""
    return F.when(scheme == "unknown", label).otherwise(
        F.concat(label, F.lit(" ("), scheme, F.lit(")"))
    )


def metric_key_parts(key: Column) -> dict[str, Column]:
    """Split ``base,filter`` at the first comma; also name the key of its standard error."""
    base = F.substring_index(key, ",", 1)
    comma = F.instr(key, ",")
    filter_name = F.when(comma > 0, F.substr(key, comma + F.lit(1))).otherwise(F.lit(""))
    return {
        "base": base,
        "filter": filter_name,
        "stderr_key": F.concat(base, F.lit("_stderr,"), filter_name),
    }


def job_spec_parts(spec: Column) -> dict[str, Column]:
    """``label:method:path``; further colons belong to the path."""
    parts = F.split(spec, ":", 3)
    return {
        "label": F.get(parts, 0),
        "method": F.get(parts, 1),
        "model_path": F.get(parts, 2),
    }


def strip(text: Column) -> Column:
    """Text without leading and trailing white space."""
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def words(text: Column, at_most: int | None = None) -> Column:
    """White-space tokens of a text; splitting stops early when only ``at_most`` are wanted."""
    body = strip(text)
    if at_most is None:
        tokens = F.split(body, fixed.WHITESPACE_RUN)
    else:
        tokens = F.slice(F.split(body, fixed.WHITESPACE_RUN, at_most + 1), 1, at_most)
    return F.when(F.length(body) > 0, tokens).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def abs_max(values: Column) -> Column:
    """Largest absolute value of an array, from its extremes (no per-element lambda)."""
    return F.greatest(F.array_max(values), -F.array_min(values))


def rint(value: Column) -> Column:
    """Round to the nearest integer, ties to even."""
    return F.rint(value)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))
