"""Text and date scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and their abbreviations.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: The forms of a floating-point literal.
NUMBER = r"^\s*[+-]?(((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
NO_ANSWER = "Context insufficient to answer"
#: Parts of sentences that are no user utterance.
NOT_USER = ("assistant:", "i can help", "here are", "let me", "you should")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_prefix(c) -> Column:
    """The ``YYYY/MM/DD`` a trimmed string starts with, else null."""
    return F.nullif(F.regexp_extract(F.trim(col(c)), r"^(\d{4}/\d{2}/\d{2})", 1), F.lit(""))


def parse_long_date(c) -> Column:
    """``1:56 pm on 8 May, 2023`` to ``2023/05/08``; unknown month ``00``; no date: unchanged; null: empty."""
    text, pattern = F.lower(col(c)), r"(\d{1,2})\s+([a-z]+),?\s+(\d{4})"
    month = F.regexp_extract(text, pattern, 2)
    number = F.coalesce(*(F.when((month == m) | (month == m[:3]), F.lit(f"{k + 1:02d}")) for k, m in enumerate(MONTHS)), F.lit("00"))
    date = F.concat_ws("/", F.regexp_extract(text, pattern, 3), number, F.lpad(F.regexp_extract(text, pattern, 1), 2, "0"))
    return F.when(F.coalesce(col(c), F.lit("")) == "", "").when(text.rlike(pattern), date).otherwise(col(c))


def norm_timestamp(session_time, timestamp=None, session_times=None) -> Column:
    """The first non-empty of a time, another, and the latest of a list: its first word with ``/`` for ``-``."""
    parts = [F.nullif(col(session_time), F.lit(""))]
    if timestamp is not None:
        parts.append(F.nullif(col(timestamp), F.lit("")))
    if session_times is not None:
        parts.append(F.array_max(F.filter(col(session_times), lambda x: x != "")))
    return F.translate(F.split_part(F.trim(F.coalesce(*parts, F.lit(""))), F.lit(" "), F.lit(1)), "-", "/")


def _date(c: Column, sep: str) -> Column:
    return F.try_to_date(F.when(F.length(c) > 0, c), f"y{sep}M{sep}d")


def time_gap(a, b, strict: bool = False) -> Column:
    """Days between two dates, as a double; both in one of two formats (one if strict), else 0."""
    x, y = F.substring(col(a), 1, 10), F.substring(col(b), 1, 10)
    gaps = [F.abs(F.datediff(_date(x, sep), _date(y, sep))).cast("double") for sep in ("/" if strict else "/-")]
    return F.coalesce(*gaps, F.lit(0.0))


def query_time(c) -> Column:
    """A question's time as a date string: its first word's first ten characters."""
    return F.substring(F.split_part(col(c), F.lit(" "), F.lit(1)), 1, 10)


def build_context(messages, caption: bool = False) -> Column:
    """Messages as ``"speaker": "text"`` without separator or escapes; captions follow the text."""

    def one(m):
        first, second = ("speaker", "text") if caption else ("role", "content")
        text = m[second]
        if caption:
            text = F.concat(text, F.when(F.coalesce(m["blip_caption"], F.lit("")) != "", F.concat(F.lit(" (attached is "), m["blip_caption"], F.lit(")"))).otherwise(""))
        return F.concat(F.lit('"'), m[first], F.lit('": "'), text, F.lit('"'))

    return F.array_join(F.transform(col(messages), one), "")


def evidence_prefix(evidence) -> Column:
    """Distinct parts before the first colon, in order; entries without one are left out."""
    return F.array_distinct(F.transform(F.filter(col(evidence), lambda x: x.contains(":")), lambda x: F.split_part(x, F.lit(":"), F.lit(1))))


def answer_or_default(answer) -> Column:
    """Empty and missing answers become a fixed sentence."""
    return F.when(F.coalesce(col(answer), F.lit("")) == "", NO_ANSWER).otherwise(col(answer))


def triple_text(src, relation, dst) -> Column:
    return F.concat_ws(" ", col(src), F.coalesce(col(relation), F.lit("relates_to")), col(dst))


def triple_embedding_text(src, relation, dst, description) -> Column:
    return F.concat(F.concat_ws(" - ", col(src), col(relation), col(dst)), F.when(F.coalesce(col(description), F.lit("")) != "", F.concat(F.lit(": "), col(description))).otherwise(""))


def entity_text(name, kind, description) -> Column:
    return F.concat(col(name), F.lit(" ("), col(kind), F.lit(")"), F.when(F.coalesce(col(description), F.lit("")) != "", F.concat(F.lit(": "), col(description))).otherwise(""))


def triple_string(src, relation, dst) -> Column:
    """``(src, relation, dst)``, null if a part is missing or empty."""
    whole = (F.coalesce(col(src), F.lit("")) != "") & (F.coalesce(col(relation), F.lit("")) != "") & (F.coalesce(col(dst), F.lit("")) != "")
    return F.when(whole, F.concat(F.lit("("), F.concat_ws(", ", col(src), col(relation), col(dst)), F.lit(")")))


def summary_text(session_id, session_time, keys, themes) -> Column:
    """One line of a summary for embedding, themes in numeric order."""
    lines = F.transform(F.array_sort(col(themes)), lambda t: F.concat(F.lit("theme_"), t["i"].cast("string"), F.lit(": "), F.coalesce(t["title"], F.lit("")), F.lit(" Summary: "), F.coalesce(t["summary"], F.lit(""))))
    return F.concat(F.lit("Session "), col(session_id), F.lit(" ("), col(session_time), F.lit(") Keys: "), col(keys), F.lit(" "), F.array_join(lines, " "))


def format_summary(session_id, session_time, keys, themes) -> Column:
    """A summary as an indented block, themes in numeric order; empty titles and summaries have no line."""
    title = lambda t: F.when(F.coalesce(t["title"], F.lit("")) != "", F.concat(F.lit("  theme_"), t["i"].cast("string"), F.lit(": "), t["title"]))
    summary = lambda t: F.when(F.coalesce(t["summary"], F.lit("")) != "", F.concat(F.lit("    Summary: "), t["summary"]))
    lines = F.flatten(F.transform(F.array_sort(F.coalesce(col(themes), F.array().cast("array<struct<i:int,title:string,summary:string>>"))), lambda t: F.array(title(t), summary(t))))
    head = F.concat(F.lit("Session "), F.coalesce(col(session_id), F.lit("")), F.lit(" ("), F.coalesce(col(session_time), F.lit("unknown")), F.lit("):"))
    return F.array_join(F.array_compact(F.concat(F.array(head, F.concat(F.lit("  Keys: "), col(keys))), lines)), "\n")


def user_utterances(text) -> Column:
    """What the user says in lines; else the first two long sentences without assistant phrases; else the first 200 characters."""
    c = F.coalesce(col(text), F.lit(""))
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x.startswith("User:"))
    said = F.filter(F.transform(lines, lambda x: strip(F.substr(x, F.lit(6)))), lambda x: x != "")
    sentences = F.filter(F.transform(F.split(c, r"[.!?]+"), strip), lambda s: (F.length(s) > 10) & ~F.lower(s).rlike("|".join(NOT_USER)))
    return F.when(F.size(said) > 0, F.array_join(said, " ")).when(F.size(sentences) > 0, F.array_join(F.slice(sentences, 1, 2), " ")).otherwise(preview(c, 200))


def normalize_text(c) -> Column:
    """Lower case, everything but letters, digits, underscores and white space to spaces, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def is_numeric(c) -> Column:
    """A number as a program writes it (digits may be grouped by ``_``; nan and infinity too), or a number and a word."""
    return col(c).rlike(NUMBER) | col(c).rlike(r"^\d+(\.\d+)?\s*\w*$")


def numeric_match(expected, output) -> Column:
    """The first number of the expected answer is among the numbers of the output."""
    number = r"\d+(?:\.\d+)?"
    return F.coalesce(F.array_contains(F.regexp_extract_all(col(output), F.lit(number), F.lit(0)), F.regexp_extract(col(expected), number, 0)) & col(expected).rlike(number), F.lit(False))


def exact_match(expected, output) -> Column:
    """The expected answer is in the output, apart from case and outer space."""
    return F.contains(F.lower(F.trim(col(output))), F.lower(F.trim(col(expected))))


def answer_match(expected, output) -> Column:
    """Substring, else number (then nothing else counts), else normalised substring, else the words of a short answer.

    A missing or blank answer or output matches nothing; an answer of punctuation alone normalises to nothing, which is in any.
    """
    strip = lambda c: F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\s+|\s+$", "")
    raw, out = strip(expected), strip(output)
    e, o = normalize_text(raw), normalize_text(out)
    few = (F.size(F.split(raw, r"\s+")) <= 3) & (F.size(F.array_except(F.split(e, " "), F.split(o, " "))) == 0)
    return F.when((raw == "") | (out == ""), False).when(exact_match(raw, out), True).when(is_numeric(raw), numeric_match(raw, out)).otherwise(F.contains(o, e) | few)


def origin_ids(origin) -> Column:
    """Session ids of a string split at commas and semicolons, trimmed, non-empty."""
    return F.filter(F.transform(F.split(col(origin), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def session_union(session_ids, session_id) -> Column:
    """A list with one more id, non-empty, in order; the argument stays as it is."""
    return F.filter(F.array_union(F.coalesce(col(session_ids), F.array().cast("array<string>")), F.array(col(session_id))), lambda x: x.isNotNull() & (x != ""))


def preview(c, n: int = 100) -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("..."))).otherwise(col(c))


def token_estimate(c) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(col(c)) / 4)).cast("bigint")
