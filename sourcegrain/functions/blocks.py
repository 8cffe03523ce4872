"""Block structure of brace and indent languages as array expressions over the lines of a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcegrain.functions import text as tx
from sourcegrain.functions.stages import let

# Comments, strings and templates hide braces; a template may hold substitutions with strings or one
# more template inside. Loops are unrolled so that long strings do not recurse.
CODE_TOKENS = (r"//[^\n]*|/\*[\s\S]*?(?:\*/|$)"
               r'|"[^"\\\n]*(?:\\[^\n][^"\\\n]*)*"?'
               r"|'[^'\\\n]*(?:\\[^\n][^'\\\n]*)*'?"
               r"|`[^`\\$]*(?:(?:\\[\s\S]|\$\{(?:[^{}`'" + '"' + r"]|'[^'\n]*'|" + r'"[^"\n]*"' + r"|`[^`]*`|\{[^{}]*\})*\}|\$)[^`\\$]*)*`?"
               r"|[{}\n]")
SIGNATURE_MAX = 30


def brace_lines(lines: Column) -> Column:
    """Per line, its braces outside strings and comments, e.g. ``{}`` or ``}{``."""
    def keep(token: Column) -> Column:
        hidden = token.rlike(r"^(/|`)")
        return (F.when(token.isin("{", "}", "\n"), token).when(hidden, F.regexp_replace(token, r"[^\n]", ""))
                .otherwise(F.lit("")))
    tokens = F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(tx.from_any("/\"'`{}\\n", CODE_TOKENS)), F.lit(0))
    return F.split(F.array_join(F.transform(tokens, keep), ""), "\n", -1)


def braces(lines: Column) -> Column:
    """All braces of a file in order: array of (line, delta)."""
    def of_line(s: Column, i: Column) -> Column:
        return F.when(s != "", F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.struct(
            (i + 1).alias("line"), F.when(c == "{", 1).otherwise(-1).alias("delta"))))
    return F.flatten(F.filter(F.transform(brace_lines(lines), of_line), lambda a: a.isNotNull()))


def block_end(all_braces: Column, start: Column) -> Column:
    """Line that closes the first block opened at or after ``start``; null when none closes."""
    near = F.filter(all_braces, lambda b: b["line"] >= start)
    first = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(0).alias("end"))

    def step(acc: Column, b: Column) -> Column:
        depth = acc["depth"] + b["delta"]
        closes = (b["delta"] < 0) & acc["opened"] & (depth <= 0)
        return F.struct(depth.alias("depth"), (acc["opened"] | (b["delta"] > 0)).alias("opened"),
                        F.when(acc["end"] > 0, acc["end"]).when(closes, b["line"]).otherwise(0).alias("end"))
    return F.nullif(F.aggregate(near, first, step, lambda acc: acc["end"]), F.lit(0))


def first_where(candidates: Column, test) -> Column:
    return F.try_element_at(F.filter(candidates, test), F.lit(1))


def span(start: Column, end: Column) -> Column:
    """Ascending line numbers, empty when the end lies before the start."""
    ends = F.struct(start.alias("start"), end.alias("end"))
    return let(ends, lambda x: F.when(x["end"] >= x["start"], F.sequence(x["start"], x["end"])).otherwise(F.array().cast("array<int>")))


def expression_arrow_end(lines: Column, start: Column) -> Column:
    """Last line of an arrow function with an expression body; null when its body is a block."""
    n = F.size(lines)
    found = first_where(span(start, F.least(n, start + 2)), lambda i: F.element_at(lines, i).contains("=>"))

    def ends(at: Column) -> Column:
        rest = tx.strip(F.regexp_extract(F.element_at(lines, at), "=>(.*)$", 1))
        following = F.ltrim(tx.strip(F.coalesce(F.try_element_at(lines, at + 1), F.lit(""))))
        block = let(rest, lambda r: r.startswith("{") | ((r == "") & following.startswith("{")))
        closing = first_where(span(at, F.least(n, at + 29)), lambda i: tx.rstrip(F.element_at(lines, i)).rlike(r"(;|\),|\))$"))
        return F.when(at.isNotNull() & ~block, F.coalesce(closing, at))
    return let(found, ends)


def is_arrow(lines: Column, start: Column) -> Column:
    found = let(F.array_join(F.slice(lines, start, 4), " "), lambda text: F.struct(F.instr(text, "=>").alias("arrow"), F.instr(text, ";").alias("semicolon")))
    return let(found, lambda p: (p["arrow"] > 0) & ((p["semicolon"] == 0) | (p["arrow"] < p["semicolon"])))


def brace_symbol_end(lines: Column, all_braces: Column, start: Column, arrow: Column) -> Column:
    line = F.element_at(lines, start)
    declared = tx.rstrip(line).endswith(";") & ~line.contains("{")
    return F.coalesce(F.when(arrow, expression_arrow_end(lines, start)), F.when(declared, start),
                      block_end(all_braces, start), start)


def indent_of(line: Column) -> Column:
    return F.length(line) - F.length(tx.lstrip(line))


def indent_block_end(lines: Column, start: Column, indent: Column) -> Column:
    """Last line of an indented block: signature by bracket depth, body by indentation."""
    n = F.size(lines)

    def measured(line: Column, i: Column) -> Column:
        code = F.when(line.contains("#"), F.regexp_replace(line, "#.*$", "")).otherwise(line)
        return let(code, lambda c: F.struct(
            (start + i).alias("line"), (F.length(F.translate(c, ")]}", "")) - F.length(F.translate(c, "([{", ""))).alias("delta"),
            (c.contains(":") & tx.rstrip(c).endswith(":")).alias("colon")))

    head = F.transform(F.slice(lines, start, SIGNATURE_MAX), measured)
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(False).alias("colon"))

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + x["delta"]
        hit = (acc["at"] == 0) & (depth <= 0)
        return F.struct(depth.alias("depth"), F.when(hit, x["line"]).otherwise(acc["at"]).alias("at"),
                        F.when(hit, x["colon"]).otherwise(acc["colon"]).alias("colon"))

    # most signatures end where they begin
    signature = let(measured(F.element_at(lines, start), F.lit(0)), lambda x: F.when(x["delta"] <= 0, F.struct(
        x["delta"].alias("depth"), x["line"].alias("at"), x["colon"].alias("colon"))).otherwise(F.aggregate(head, zero, step)))

    def ends(sig: Column) -> Column:
        body = F.when(sig["at"] == 0, start).otherwise(sig["at"])

        def closes(k: Column) -> Column:
            line = F.element_at(lines, k)
            return let(tx.lstrip(line), lambda t: (t != "") & (F.length(line) - F.length(t) <= indent) & ~t.startswith("#"))
        closer = F.coalesce(first_where(span(body + 1, n), closes), n + 1)
        last = F.array_max(F.filter(span(body + 1, closer - 1), lambda k: tx.lstrip(F.element_at(lines, k)) != ""))
        return F.when((sig["at"] > 0) & ~sig["colon"], sig["at"]).otherwise(F.coalesce(last, body))
    return let(signature, ends)
