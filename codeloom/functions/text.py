"""Text functions on columns: token estimates, normalisation, rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the comments' authors' tools define it, which is more than Java's \s.
WS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# Labels of comment categories.
CATEGORY_LABELS = {
    "bug": "Bug",
    "security": "Security",
    "performance": "Performance",
    "error-handling": "Error handling",
    "concurrency": "Concurrency",
    "api-misuse": "API misuse",
    "maintainability": "Maintainability",
    "testing": "Testing",
}


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, in which characters beyond the basic plane count twice."""
    return F.char_length(text) + F.char_length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def estimate_tokens(text: Column) -> Column:
    """A third of the UTF-16 length, rounded up."""
    return F.ceil(F.octet_length(F.encode(text, "UTF-16BE")) / 6).cast("int")


def trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{WS}+", ""), f"{WS}+$", "")


def normalize_path(path: Column) -> Column:
    """Trims and drops one leading ``./`` or ``/`` and then one leading ``a/`` or ``b/``."""
    return F.regexp_replace(F.regexp_replace(trim(path), r"^\.?/", ""), r"^[ab]/", "")


def normalize_code(text: Column) -> Column:
    return trim(F.regexp_replace(text, f"{WS}+", " "))


def normalize_evidence(evidence: Column) -> Column:
    """Undoes what quoting adds: code fences, a pair of backticks, ``R<n>`` and ``<n>|`` labels, ``+`` and ``-`` marks."""
    out = F.regexp_replace(F.regexp_replace(trim(evidence), r"\A```[A-Za-z0-9_-]*\n?", ""), r"\n?```\z", "")
    out = F.when(out.rlike(r"\A`[^`]+`\z"), F.regexp_replace(out, r"\A`|`\z", "")).otherwise(out)

    def bare(line: Column) -> Column:
        line = F.regexp_replace(line, rf"^{WS}*R[0-9]+{WS}?", "")
        line = F.regexp_replace(line, rf"^{WS}*[0-9]+\|{WS}?", "")
        return F.regexp_replace(line, rf"^[+-]{WS}*", "")

    return normalize_code(F.array_join(F.transform(F.split(out, "\n"), bare), "\n"))


def words(text: Column) -> Column:
    """The distinct lower-cased words of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays without repeats; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def escape_attribute(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))


def file_lines(content: Column) -> Column:
    return F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n")


def padded(number: Column, width: Column) -> Column:
    text = number.cast("string")
    return F.concat(F.repeat(F.lit(" "), F.greatest(width - F.char_length(text), F.lit(0))), text)


def numbered(lines: Column, first: Column, width: Column) -> Column:
    """``<n>| <line>`` for each line, the numbers padded to the width."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat(padded(first + i, width), F.lit("| "), x)), "\n")


def render_file(path: Column, content: Column) -> Column:
    """A whole file with numbered lines; a final line break adds no line."""
    lines = file_lines(content)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    body = numbered(lines, F.lit(1), F.char_length(F.size(lines).cast("string")))
    return F.concat(F.lit('<file path="'), escape_attribute(path), F.lit('" ref="head">\n'), body, F.lit("\n</file>"))


def render_diff(path: Column, status: Column, hunks: Column) -> Column:
    """One file's diff; lines of the new side carry their number as ``R<n>``. hunks is as in operators.diff."""

    def line(x: Column) -> Column:
        label = F.when(x["type"] != "del", F.concat(F.lit("R"), x["new_line"].cast("string"))).otherwise(F.lit(""))
        mark = F.when(x["type"] == "add", "+").when(x["type"] == "del", "-").otherwise(" ")
        return F.concat(F.repeat(F.lit(" "), F.greatest(6 - F.char_length(label), F.lit(0))), label, F.lit(" "), mark, x["content"])

    def hunk(h: Column) -> Column:
        numbers = [h[k].cast("string") for k in ("old_start", "old_lines", "new_start", "new_lines")]
        head = F.concat(F.lit("@@ -"), numbers[0], F.lit(","), numbers[1], F.lit(" +"), numbers[2], F.lit(","), numbers[3], F.lit(" @@"))
        return F.concat(F.array(head), F.transform(h["lines"], line))

    first = F.concat(F.lit('<diff path="'), escape_attribute(path), F.lit('" status="'), status, F.lit('">'))
    return F.array_join(F.concat(F.array(first), F.flatten(F.transform(hunks, hunk)), F.array(F.lit("</diff>"))), "\n")


def comment_body(category: Column, severity: Column, claim: Column, evidence: Column, fix: Column) -> Column:
    """The Markdown of one inline comment."""
    label = F.create_map(*[F.lit(x) for pair in CATEGORY_LABELS.items() for x in pair])[category]
    quote, fix = trim(evidence), trim(F.coalesce(fix, F.lit("")))
    ticks = F.when(quote.contains("```"), "````").otherwise("```")
    shown = F.when(quote.contains("\n"), F.concat(ticks, F.lit("\n"), quote, F.lit("\n"), ticks)).otherwise(F.concat(F.lit("> `"), F.replace(quote, F.lit("`"), F.lit("'")), F.lit("`")))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("**"), label, F.lit(" ("), severity, F.lit(")**: "), trim(claim)),
        F.when(quote != "", shown),
        F.when(fix != "", F.concat(F.lit("**Suggested fix:** "), fix)),
    )


def review_body(name: str, posted: Column, strategy: Column, model: Column) -> Column:
    """The summary of a review by ``name``."""
    many = F.when(posted == 1, "").otherwise("s")
    said = F.when(posted == 0, F.lit(f"{name} found no issues to flag in this change.")).otherwise(F.concat(F.lit(f"{name} left "), posted.cast("string"), F.lit(" comment"), many, F.lit(".")))
    return F.concat(said, F.lit("\n\n<sub>strategy "), strategy, F.lit(" · model "), model, F.lit("</sub>"))


def omitted_note(paths: Column) -> Column:
    note = F.concat(F.lit("\nThese changed files were left out to fit the context budget, so you cannot comment on them: "), F.array_join(paths, ", "), F.lit(".\n"))
    return F.when(F.size(paths) == 0, "").otherwise(note)


def relation(role: Column, related_to: Column, distance: Column) -> Column:
    hops = F.when(distance > 1, F.concat(F.lit(" ("), distance.cast("string"), F.lit(" hops)"))).otherwise("")
    said = F.when(role == "callee", "called by ").when(role == "base", "extended or implemented by ").otherwise("calls ")
    return F.when(role == "enclosing", "changed in this diff").otherwise(F.concat(said, related_to, hops))


def render_template(template: str, values: dict[str, str]) -> str:
    """Fills ``{{name}}`` once, without looking into the values; unknown and unused names are errors."""
    used: set[str] = set()

    def fill(match: re.Match) -> str:
        if match[1] not in values:
            raise ValueError(f"template variable not provided: {match[1]}")
        used.add(match[1])
        return values[match[1]]

    out = re.sub(r"\{\{([A-Za-z0-9_]+)\}\}", fill, template)
    if rest := [k for k in values if k not in used]:
        raise ValueError(f"template variables not used: {', '.join(rest)}")
    return out


def template_column(template: str, values: dict[str, Column]) -> Column:
    """The same over columns: the template's fixed parts are joined with the values."""
    names = re.findall(r"\{\{([A-Za-z0-9_]+)\}\}", template)
    render_template(template, dict.fromkeys(values, ""))
    fixed = re.split(r"\{\{[A-Za-z0-9_]+\}\}", template)
    parts: list[Column] = [F.lit(fixed[0])]
    for name, text in zip(names, fixed[1:], strict=True):
        parts += [values[name], F.lit(text)]
    return F.concat(*parts)


