"""Column functions on text: keyword tests, token sets, extraction, slugs."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import patterns as P
from siftline.functions import vocab as V

Col = Column | str


def as_col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Col) -> Column:
    """The text, with NULL read as ''."""
    return F.coalesce(as_col(c), F.lit(""))


def filled(c: Col) -> Column:
    """The text, with '' read as NULL."""
    return F.nullif(as_col(c), F.lit(""))


def combined(title: Col, text: Col) -> Column:
    """Lower-case ``title + ' ' + text``; the blank stays when the title is empty."""
    return F.lower(F.concat(blank(title), F.lit(" "), blank(text)))


def once(value: Column) -> Column:
    """The value, computed once per row.

    A filter above a projection is pushed through it by copying the projected
    expression into the filter, once per mention. For a chain of text gates those
    copies multiply, so the gate codes are tied to the partition id, which keeps
    the optimizer from copying them.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def any_keyword(text: Col, vocab: Sequence[str], word_boundary: bool = False) -> Column:
    """Does the text hold any entry of the vocabulary?

    Substring test by default. With ``word_boundary`` single words must stand
    alone and phrases are still substrings.
    """
    text = as_col(text)
    if not word_boundary:
        return any_keyword_in(text, word_array(vocab))
    singles = [w for w in vocab if " " not in w]
    phrases = [w for w in vocab if " " in w]
    tests = [any_keyword_in(text, word_array(phrases))] if phrases else []
    if singles:  # a plain look for the words is far cheaper than the pattern
        tests.append(any_keyword_in(text, word_array(singles)) & text.rlike(standing_alone(singles)))
    return any_of(tests)


def word_array(vocab: Sequence[str]) -> Column:
    """The words as one constant array (folded when the query is planned)."""
    return F.array(*[F.lit(w) for w in vocab])


def standing_alone(singles: Sequence[str]) -> str:
    """Pattern for any of the words with no word character on either side."""
    return f"(?:^|{P.NOT_WORD})(?:{'|'.join(re.escape(w) for w in singles)})(?:$|{P.NOT_WORD})"


def any_keyword_in(text: Col, vocab_array: Col) -> Column:
    """As ``any_keyword`` for a vocabulary held in an ``array<string>`` column."""
    # Bound, or a text that is an expression would be computed anew for every word.
    return bound(as_col(text), lambda t: F.exists(as_col(vocab_array), t.contains))


def head(regex: str) -> str:
    """The plain lower-case text that every match of a pattern starts with, letter case aside."""
    if "|" in re.sub(r"\(\?:[^()]*\)", "", regex):
        return ""
    found = re.match(r"[a-z ]*", regex)[0]
    return found[:-1] if regex[len(found):len(found) + 1] in ("?", "*", "{") else found


def find_all(text: Col, regexes: Sequence[str], group: int = 1, lower: Col | None = None) -> Column:
    """Matches of every pattern, pattern by pattern. ``lower``, the lower-case text, spares most searches."""
    text, none = as_col(text), F.array().cast("array<string>")

    def found(regex: str) -> Column:
        every = F.regexp_extract_all(text, F.lit("(?i)" + regex), group)
        return every if lower is None else F.when(as_col(lower).contains(head(regex)), every).otherwise(none)

    return F.concat(*[found(r) for r in regexes])


def any_pattern(text: Col, regexes: Sequence[str], lower: Col | None = None) -> Column:
    test = as_col(text).rlike("(?i)(?:" + "|".join(regexes) + ")")
    return test if lower is None else any_keyword_in(lower, word_array([head(r) for r in regexes])) & test


def first_match(text: Col, regex: str, group: int = 1) -> Column:
    """The group in the first match, NULL without a match."""
    text = as_col(text)
    return F.when(text.rlike("(?i)" + regex), F.regexp_extract(text, "(?i)" + regex, group))


def trimmed(text: Col) -> Column:
    return F.btrim(as_col(text), F.lit(P.SPACES))


def context_of(text: Col, regexes: Sequence[str], width: int = 50, lower: Col | None = None) -> Column:
    """The first pattern that matches, with ``width`` characters on each side."""
    text = as_col(text)

    def around(regex: str) -> Column:
        full = f"(?is)^(.*?)({regex})"
        before = F.length(F.regexp_extract(text, full, 1))
        end = before + F.length(F.regexp_extract(text, full, 2)) + width
        start = F.greatest(before - width, F.lit(0))
        return F.when(text.rlike("(?i)" + regex), trimmed(F.substring(text, start + 1, end - start)))

    # Most texts match none of the patterns; one look for any of them spares the rest.
    return F.when(any_pattern(text, regexes, lower), F.coalesce(*[around(r) for r in regexes]))


def tokens(text: Col) -> Column:
    """Whitespace-separated tokens."""
    return F.filter(F.split(as_col(text), P.SPACE + "+"), lambda t: t != "")


def token_set(text: Col) -> Column:
    """Distinct lower-case whitespace tokens."""
    return F.array_distinct(tokens(F.lower(as_col(text))))


def word_list(text: Col) -> Column:
    """Lower-case words of three or more characters."""
    return F.regexp_extract_all(F.lower(as_col(text)), F.lit(f"({P.LONG_WORD})"), 1)


def discovery_keywords(
    features: Col, target: Col, title: Col, description: Col, n: int = 15, prefix: int = 300
) -> Column:
    """Search words: features, target, title words, words at the head of the description."""
    none = F.array().cast("array<string>")
    target = filled(target)
    return F.slice(
        F.array_distinct(
            F.concat(
                F.coalesce(as_col(features), none),
                F.when(target.isNotNull(), F.array(target)).otherwise(none),
                word_list(blank(title)),
                word_list(F.substring(blank(description), 1, prefix)),
            )
        ),
        1,
        n,
    )


def split_list(text: Col) -> Column:
    """Comma-separated items, trimmed."""
    return F.transform(F.split(as_col(text), ","), trimmed)


def next_words(
    text: Col,
    markers: Sequence[str] = V.FEATURE_WORD,
    n: int = 5,
    width: int = 20,
    default: Sequence[str] = ("features", "data"),
) -> Column:
    """The word after each marker word."""
    either = "|".join(re.escape(m) for m in markers)
    pattern = f"(?<![^{P.SPACE_SET}])(?:{either})(?={P.SPACE}+([^{P.SPACE_SET}]{{1,{width}}}))"

    def after(low: Column) -> Column:
        return F.when(any_keyword_in(low, word_array(markers)), F.regexp_extract_all(low, F.lit(pattern), 1))

    def or_default(found: Column) -> Column:
        return F.when(F.size(found) > 0, F.slice(found, 1, n)).otherwise(F.array(*[F.lit(d) for d in default]))

    return bound(bound(F.lower(blank(text)), after), or_default)


def is_question(title: Col) -> Column:
    """A question word in the last ten characters, or '?' anywhere."""
    title = F.lower(blank(title))
    tail = F.when(F.length(title) > 10, F.substring(title, -10, 10)).otherwise(title)
    return any_keyword(tail, V.QUESTION_WORD) | title.contains("?")


def slug(name: Col, width: int = 50) -> Column:
    """File-system name: word characters joined by '_'."""
    s = F.regexp_replace(blank(name), f"[^{P.WORD[1:-1]}{P.SPACE_SET}-]", "")
    s = F.lower(F.regexp_replace(s, f"[-{P.SPACE_SET}]+", "_"))
    return F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, width)


def repo_slug(name: Col, width: int = 100, default: str = "ml-solution") -> Column:
    """Repository name: word characters and inner hyphens."""
    s = F.lower(F.regexp_replace(blank(name), f"[^{P.WORD[1:-1]}-]", ""))
    s = F.regexp_replace(F.substring(s, 1, width), "^-+|-+$", "")
    return F.coalesce(filled(s), F.lit(default))


def task_by_keyword(text: Col, default: str = "unknown") -> Column:
    def task(low: Column) -> Column:
        return (
            F.when(any_keyword(low, V.TASK_CLASSIFICATION), "classification")
            .when(any_keyword(low, V.TASK_REGRESSION), "regression")
            .when(any_keyword(low, V.TASK_CLUSTERING), "clustering")
            .otherwise(default)
        )

    return bound(F.lower(as_col(text)), task)


def owner_and_name(ref: Col) -> Column:
    """struct(owner, name) of 'owner/name', NULL for any other shape."""
    parts = F.split(as_col(ref), "/")
    return F.when(
        F.size(parts) == 2, F.struct(parts[0].alias("owner"), parts[1].alias("name"))
    )


def join_filled(*parts: Column) -> Column:
    """Non-empty parts separated by one blank."""
    return F.concat_ws(" ", *[filled(p) for p in parts])


def problem_text(
    title: Col,
    description: Col,
    task_type: Col,
    key_features: Col,
    width: int | None = 500,
) -> Column:
    """The text a post is matched by."""
    title, task, feats = as_col(title), filled(task_type), as_col(key_features)
    desc = as_col(description)
    explains = any_keyword(F.lower(title), V.EXPLAIN_TITLE)
    hint = F.concat(
        F.coalesce(task, F.lit("classification")), F.lit(" dataset machine learning data")
    )
    return join_filled(
        title,
        F.when(filled(title).isNotNull() & explains, hint),
        desc if width is None else F.substring(desc, 1, width),
        F.when(task.isNotNull(), F.concat(F.lit("Task type: "), task)),
        F.when(
            F.size(feats) > 0,
            F.concat(F.lit("Features: "), F.array_join(F.slice(feats, 1, 5), ", ")),
        ),
    )


def dataset_text(title: Col, description: Col, tags: Col, width: int | None = 500) -> Column:
    """The text a catalog entry is matched by."""
    desc, tags = as_col(description), as_col(tags)
    return join_filled(
        as_col(title),
        desc if width is None else F.substring(desc, 1, width),
        F.when(F.size(tags) > 0, F.array_join(F.slice(tags, 1, 5), " ")),
    )


def problem_signature(title: Col, description: Col) -> Column:
    """Title and description in one line, whichever of them is there."""
    return join_filled(trimmed(blank(title)), trimmed(blank(description)))


def model_signature(problem_title, problem_desc, dataset_id, dataset_title, dataset_desc, task):
    """'problem | dataset | task' in one line."""
    sp = F.lit(" ")
    return trimmed(
        F.concat(
            blank(problem_title), sp, blank(problem_desc), F.lit(" | "),
            blank(dataset_id), sp, blank(dataset_title), sp, blank(dataset_desc), F.lit(" | "),
            blank(task),
        )
    )


def enhanced_statement(target: Col, features: Col, use: Col | None = None) -> Column:
    """'Predict T using f1, f2, f3 [for use]'."""
    text = F.concat(
        F.lit("Predict "), F.coalesce(as_col(target), F.lit("target")), F.lit(" using "),
        F.array_join(F.slice(F.coalesce(as_col(features), F.array().cast("array<string>")), 1, 3), ", "),
    )
    if use is None:
        return text
    return F.concat(text, F.lit(" for "), F.coalesce(as_col(use), F.lit("business decision support")))


def text_hash(title: Col, description: Col, prefix: int | None = None) -> Column:
    """md5 of the title and the description, or of its first ``prefix`` characters."""
    text = blank(description) if prefix is None else F.substring(blank(description), 1, prefix)
    return F.md5(F.concat(blank(title), text))
