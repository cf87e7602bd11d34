"""Row-wise text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import schema as S


WHITESPACE = " \t\n\r\f\v"


def strip(text: Column) -> Column:
    """Trim every kind of ASCII white space, not blanks alone."""
    return F.btrim(text, F.lit(WHITESPACE))


def class_label(domain: str = S.DOMAIN, topic: str = S.TOPIC, separator: str = "_") -> Column:
    """Display form of a class; null when either part is null."""
    return F.concat(F.col(domain), F.lit(separator), F.col(topic))


def split_label(label: str, separator: str = "_") -> tuple[Column, Column]:
    """(domain, topic) of an imported label, cut at the first separator only."""
    at = F.instr(F.col(label), separator)
    domain = F.when(at > 0, F.substring(F.col(label), F.lit(1), at - 1)).otherwise(F.col(label))
    topic = F.when(at > 0, F.substring(F.col(label), at + len(separator), F.length(label)))
    return domain, topic


def attribute_text(name: str = S.NAME, description: str = S.DESCRIPTION) -> Column:
    return F.concat(F.coalesce(F.col(name), F.lit("")), F.lit(" "), F.coalesce(F.col(description), F.lit("")))


def sample_identity(name: str = S.NAME, description: str = S.DESCRIPTION) -> Column:
    return F.concat_ws("_", F.col(name), F.col(description))


def effective_text(df: DataFrame) -> Column:
    """The rewritten description where that column exists, else the original one."""
    if S.PROCESSED in df.columns:
        return F.coalesce(F.col(S.PROCESSED), F.col(S.DESCRIPTION))
    return F.col(S.DESCRIPTION)


def render_template(domain: Column, topic: Column, definition: Column, template: str = S.TEMPLATE_TEXT) -> Column:
    """Fill ``{domain}``, ``{topic}`` and ``{definition}`` of a template text."""
    values = {"domain": domain, "topic": topic, "definition": definition}
    pieces, rest = [], template
    while rest:
        spots = {k: rest.find("{" + k + "}") for k in values}
        found = [(at, k) for k, at in spots.items() if at >= 0]
        if not found:
            pieces.append(F.lit(rest))
            break
        at, key = min(found)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(values[key])
        rest = rest[at + len(key) + 2 :]
    return F.concat(*pieces)


def after_prefix(text: Column, prefix: str = S.REWRITE_PREFIX) -> Column:
    """Text between the first and second occurrence of the prefix, trimmed; the whole text without it."""
    quoted = "\\Q" + prefix + "\\E"
    return F.when(text.contains(prefix), strip(F.split(text, quoted)[1])).otherwise(text)


def text_spec(spec: Column) -> tuple[Column, Column]:
    """(name, text) of ``name: text``; the name is ``unknown`` when there is no colon."""
    parts = F.split(spec, ":", 2)
    has_name = F.size(parts) == 2
    name = F.when(has_name, strip(F.get(parts, F.lit(0)))).otherwise(F.lit("unknown"))
    text = F.when(has_name, strip(F.get(parts, F.lit(1)))).otherwise(strip(spec))
    return name, text


def is_synthetic(name: str = S.NAME) -> Column:
    return F.col(name).startswith("synthetic_")


def is_snake_case(name: Column) -> Column:
    return name.rlike(S.SNAKE_CASE)
