"""Text measurements as columns: all run inside the JVM, and unneeded ones are pruned."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def tokens(text: Column) -> Column:
    """Words, with apostrophes inside."""
    return count(text, P.TOKEN)


def sentences(text: Column) -> Column:
    """Runs of end marks; at least 1."""
    return F.greatest(F.lit(1).cast("long"), count(text, "(?dU)" + P.SENTENCE_END))


def strip(text: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def paragraphs(text: Column, separator: str = r"(?U)\n\s*\n+") -> Column:
    """Non-empty stripped parts between blank lines. The sampler's rule is the separator two line feeds."""
    return F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")


def uniformity(counts: Column) -> Column:
    """1 / (1 + deviation / mean) of an array of numbers; 0 without a positive mean."""
    n = F.size(counts)
    mean = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) / n
    deviation = F.when(n < 2, 0.0).otherwise(F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n))
    return F.when((n > 0) & (mean > 0), 1.0 / (1.0 + deviation / mean)).otherwise(0.0)


def fold(text: Column) -> Column:
    """The case folding that (?iU) applies to single characters."""
    return F.lower(F.upper(text))


def present(text: Column, pattern: str, folded: Column | None = None) -> Column:
    """Counts a pattern of the bank. Where the folded text lacks the literals that any match holds, which is a plain search, the pattern is not run."""
    n, need = count(text, P.flags(pattern)), P.needles(pattern)
    if not need or len(need) > 4:
        return n
    folded = fold(text) if folded is None else folded
    some = folded.contains(need[0])
    for x in need[1:]:
        some = some | folded.contains(x)
    return F.when(some, n).when(text.isNotNull(), F.lit(0).cast("long"))


def items(text: Column, family: Mapping[str, str]) -> dict[str, Column]:
    """One count for each pattern of a family."""
    return {name: present(text, p) for name, p in family.items()}


def total(columns: Sequence[Column]) -> Column:
    out = F.lit(0).cast("long")
    for c in columns:
        out = out + c
    return out


def family_counts(text: Column, families: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, Column]:
    """X11: sums by family, with openers and closers pooled."""
    out = {f: total(list(items(text, p).values())) for f, p in (families or P.FAMILIES).items()}
    if {"stock_openers", "stock_closers"} <= set(out):
        out["stock_openers_closers"] = out["stock_openers"] + out["stock_closers"]
    return out


def rate(n: Column, of: Column, per: float = 1000.0) -> Column:
    """A rate whose denominator counts as 1 at least."""
    return n.cast("double") * F.lit(per) / F.greatest(of.cast("double"), F.lit(1.0))


def plain_quotes(text: Column) -> Column:
    return F.translate(text, P.QUOTES, "'" * len(P.QUOTES))


def benchmark_tokens(text: Column) -> Column:
    """Lower-case alphabetic tokens with at most one inner apostrophe."""
    found = F.transform(F.regexp_extract_all(plain_quotes(F.lower(text)), F.lit("[a-z']+"), F.lit(0)), lambda t: F.regexp_replace(t, "^'+|'+$", ""))
    return F.filter(found, lambda t: t.rlike("^[a-z]+(?:'[a-z]+)?$"))


def ngrams(words: Column, n: int) -> Column:
    """N-grams of an array of words, joined by blanks."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


#: Words that no phrase consists of, words that none starts or ends with, and bullets.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "if", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with", "you", "your")
EDGE_WORDS = ("and", "or", "the", "a", "an", "to", "of")
BULLETS = ("-", "*", "+", "**", "##", "###", "####", "#####", "######")


def skipped(gram: Column) -> Column:
    """whether an n-gram is skipped: bullets, stop words alone, an edge word at either end, or one word that is short or a number."""
    w = F.split(gram, " ")
    among = lambda words: F.array(*[F.lit(x) for x in words])
    alone = (F.size(w) == 1) & ((F.length(gram) < 3) | gram.rlike(r"^\p{Nd}+$"))
    return F.arrays_overlap(w, among(BULLETS)) | alone | F.forall(w, lambda x: F.array_contains(among(STOP_WORDS), x)) | (F.size(w) > 1) & (F.element_at(w, 1).isin(*EDGE_WORDS) | F.element_at(w, -1).isin(*EDGE_WORDS))


def listed(words: Column, known: Sequence[str]) -> Column:
    """How many of the words are in a list."""
    known_words = F.array(*[F.lit(w) for w in known]).cast("array<string>")
    return F.size(F.filter(words, lambda w: F.array_contains(known_words, w))).cast("long")


def scaled(value: Column, kind: str) -> Column:
    low, high = P.SCORE_RANGES[kind]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - F.lit(low)) / F.lit(high - low)))


def weighted_score(words: Column, trigrams: Column, contrast: Column) -> Column:
    """0 to 100 from rates for words, trigrams (both for 1,000 words) and contrasts (for 1,000 characters)."""
    w = P.SCORE_WEIGHTS
    return F.lit(100.0) * (scaled(words, "words") * w["words"] + scaled(contrast, "contrast") * w["contrast"] + scaled(trigrams, "trigrams") * w["trigrams"])


def final_answer(text: Column) -> Column:
    """Without reasoning blocks; an opener that is never closed ends the text."""
    out = F.regexp_replace(text, r"(?is)<\s*(think|reasoning)\s*>.*?<\s*/\s*\1\s*>", "")
    out = F.regexp_replace(out, r"(?is)```(?:thinking|reasoning)\b.*?```", "")
    out = F.regexp_replace(out, r"(?is)<\s*(?:think|reasoning)\s*>.*", "")
    return strip(F.regexp_replace(out, r"(?is)```(?:thinking|reasoning)\b.*", ""))


def without_roles(text: Column) -> Column:
    """Without lines that only name a chat role."""
    return strip(F.regexp_replace(text, r"(?imdU)^\s*(?:assistant|user|system)\s*$\n?", ""))


#: Markup of reasoning traces.
MARKERS = {"think_tag": r"(?i)<\s*/?\s*think\s*>", "reasoning_tag": r"(?i)<\s*/?\s*reasoning\s*>", "analysis_open": r"(?i)<\s*analysis\s*>", "analysis_close": r"(?i)<\s*/\s*analysis\s*>", "thinking_fence": r"(?i)```thinking\b", "reasoning_fence": r"(?i)```reasoning\b"}


def markers(text: Column, more: Mapping[str, str] | None = None) -> dict[str, Column]:
    """Counts of markup that should not be there."""
    return {name: count(text, p) for name, p in (MARKERS | dict(more or {})).items()}


def without_markdown(text: Column) -> Column:
    """The words of a text without fences, links, quotes, headings, bullets, tables and emphasis."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    for pattern, to in (
        ("```[^\n`]*\n?", ""), ("`([^`\n]+)`", "$1"), (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</?(?:details|summary|b|strong|i|em)\b[^>]*>", ""),
        (r"!?\[([^\]]*)\]\([^)]+\)", "$1"),
    ):
        out = F.regexp_replace(out, pattern, to)

    def line(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(strip(x), r"^>+\s*", ""), r"^#{1,6}\s*", "")
        number = x.rlike(r"^(?:0?[1-9]|[1-4]\d|50)[.)]$")
        x = F.when(number, F.lit(None)).otherwise(F.regexp_replace(x, r"^(?:(?:[-*+]|\d+[.)])\s+)+", ""))
        x = F.when(~x.rlike(r"^[-*_]{3,}$") & ~x.rlike(r"^\|?(?:\s*:?-{3,}:?\s*\|)+\s*:?-{3,}:?\s*\|?$"), x)
        x = F.when(x.contains("|"), F.regexp_replace(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\s*\|\s*", " ")).otherwise(x)
        x = F.regexp_replace(F.regexp_replace(x, r"(\*\*|__)(.*?)\1", "$2"), r"(\*|_)(.*?)\1", "$2")
        return strip(F.regexp_replace(F.translate(x, "*_`", ""), "[ \t]+", " "))

    kept = F.filter(F.transform(F.split(out, "\n"), line), lambda x: x.isNotNull())
    return strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


def one_spaced(text: Column) -> Column:
    """White space (no-break space included) as single blanks, without a leading role name."""
    return F.regexp_replace(strip(F.regexp_replace(text, r"(?U)[\s ]+", " ")), r"^(?i)assistant\s+", "")


def words(text: Column) -> Column:
    """Parts between white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")).cast("long")


def response_requirements(n: Column) -> Column:
    """The sentence that asks for a number of words."""
    return F.concat(F.lit("Response requirements: aim for about "), n.cast("string"), F.when(n == 1, " word.").otherwise(" words."))


def output_budget(least: int, most: int) -> Column:
    """The token budget of an answer, whatever its target: the most, if the limits make sense."""
    if least <= 0 or most < least:
        raise ValueError("the limits of output tokens must be positive and in order")
    return F.lit(most)


# Words that decide a token's class.
CONTRACTION_MARKS = r"(?i)(n't|n’t|didn|wasn|weren|couldn|wouldn|shouldn|don|doesn|hadn)"
NEGATION_WORDS = ("not", "no", "never", "cannot", "did", "do", "does", "was", "were", "had", "could", "would", "should")
DISCOURSE_WORDS = ("however", "therefore", "thus", "moreover", "furthermore", "additionally", "consequently", "meanwhile", "instead", "otherwise", "nevertheless", "nonetheless", "similarly", "likewise", "finally", "first", "second", "third", "overall", "ultimately", "specifically", "notably", "indeed", "for", "example", "instance")
STYLE_WORDS = ("also", "then", "when", "while", "because", "although", "though", "since", "if", "as", "which", "that", "this", "these", "those", "can", "may", "might", "must", "should", "would", "could", "will", "feel", "feels", "help", "helps", "make", "makes")


def token_class(token: Column) -> Column:
    """The first class that fits."""
    t = strip(token)
    word = F.lower(t)
    return (
        F.when(token.rlike("[\n\r]"), "line_break")
        .when((token != "") & (t == ""), "whitespace")
        .when(t == "", "empty")
        .when(t.rlike(CONTRACTION_MARKS), "contraction_piece")
        .when(word.isin(*NEGATION_WORDS), "expanded_negation_word")
        .when(word.isin(*DISCOURSE_WORDS), "discourse_marker_word")
        .when(word.isin(*STYLE_WORDS), "style_function_word")
        .when(t.rlike("^[.!?]+$"), "sentence_boundary")
        .when(t.rlike(r"^[^\p{L}\p{N}_]+$"), "punctuation")
        .when(t.rlike(r"[\p{L}\p{N}_]"), "word")
        .otherwise("other")
    )


def language_label(label: Column) -> Column:
    """A detector's label: without prefix, English in all its spellings as en."""
    x = F.replace(F.regexp_replace(F.nullif(F.lower(strip(label)), F.lit("")), "^__label__", ""), F.lit("_"), F.lit("-"))
    return F.when(x.isin("en", "eng", "english") | x.startswith("en-"), "en").otherwise(x)


def signed_log_ratio(a: Column, b: Column, epsilon: float = 1e-9) -> Column:
    """log2 of two values with a small addition; null if either is, or is not positive."""
    x, y = a + F.lit(epsilon), b + F.lit(epsilon)
    return F.when((x > 0) & (y > 0), F.log2(x / F.nullif(y, F.lit(0.0))))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; infinite for a positive a over 0, 0 for 0 over 0, null if either is."""
    known = a.isNotNull() & b.isNotNull()
    return F.when(known & (b != 0), a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))).when(known & (a > 0), F.lit(float("inf"))).when(known, F.lit(0.0))


def safe_rate(a: Column, b: Column) -> Column:
    """a / b, and 0 over nothing."""
    return F.when(b != 0, a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))


def edited(text: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The text after regex edits in order, and the number of edits."""
    n = F.lit(0).cast("long")
    for pattern, to in rules:
        n = n + count(text, pattern)
        text = F.regexp_replace(text, pattern, to)
    return text, n


def first_words(text: Column, n: int) -> Column:
    """The first n words, closed by a period."""
    return F.concat(F.regexp_replace(F.array_join(F.slice(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""), 1, n), " "), r"[.,;:!?]+$", ""), F.lit("."))


def snippet(text: Column, pattern: str, around: int = 120, head: int = 240) -> Column:
    """What lies around the first match, else the start of the text."""
    hit = F.regexp_substr(text, F.lit(pattern))
    at = F.instr(text, hit)
    return F.when(hit.isNotNull() & (hit != ""), F.substring(text, F.greatest(F.lit(1), at - around), F.length(hit) + 2 * around)).otherwise(F.substring(text, 1, head))


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` of a value that is computed once for each row, however often ``of`` names it. Inside a condition the planner would compute it again each time."""
    return F.transform(F.array(value), of)[0]


def quality_penalty(text: Column) -> Column:
    """A sum of penalties for code marks, symbols, shouting, title case and crowded connectors; 1 for a blank text.

    Characters are counted as what is left when runs of all others go, and words as marks in a string, so no character or word is a value of its own.
    """
    left = lambda x, pattern: F.length(F.regexp_replace(x, pattern, "")).cast("double")
    counted = lambda x, pattern: F.length(F.regexp_replace(x, pattern, "$1")).cast("double")
    # Each word of letters with a blank before it, and a 1 or 0 for each word: whether it is in title case.
    worded = lambda t: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(t, F.lit(r"(?U)\b[A-Za-z]+\b"), F.lit(0)), " "))
    titled = lambda w: F.trim(F.regexp_replace(F.regexp_replace(w, r" [A-Z][a-z]{2,}(?![A-Za-z])", "1"), " [A-Za-z]+", "0"))

    def of(x: Column) -> Column:
        t, lower, w, flags = x["t"], x["lower"], x["w"], x["flags"]
        n = lambda pattern: count(t, "(?U)" + pattern).cast("double")
        size = F.length(flags).cast("double")
        among = lambda words: count(w, f"(?i) (?:{'|'.join(words)})(?![A-Za-z])") / F.greatest(size, F.lit(1.0))
        above = lambda share, free, factor: F.when(size >= P.PENALTY_LEAST_WORDS, F.greatest(F.lit(0.0), share - free) * factor).otherwise(0.0)
        marks = F.lit(0.0)
        for m in P.CODE_MARKS:
            marks = marks + (F.length(lower) - F.length(F.replace(lower, F.lit(m), F.lit("")))) / F.lit(float(len(m)))
        titles = left(flags, "0+") / F.greatest(size, F.lit(1.0))
        # Words from the fifth of a run of title-case words on.
        late = counted(flags, f"0+|1{{1,{P.PENALTY_FREE_TITLE_RUN}}}(1*)")

        def total_(c: Column) -> Column:
            dense, letters, symbols = F.greatest(c["dense"], F.lit(1.0)), c["letters"], c["symbols"]
            return (
                marks * P.PENALTY_CODE_MARK
                + F.least(F.lit(P.PENALTY_MOST_SYMBOLS), symbols * P.PENALTY_SYMBOL_SHARE / dense)
                + n(r"[^\p{L}\p{N}_\s]{2,}") * P.PENALTY_SYMBOL_RUN
                + F.when(t.contains("-"), n(r"\b\d{4}-\d{2}-\d{2}[A-Za-z]")).otherwise(0.0) * P.PENALTY_GLUED_DATE
                + n(r"(?:^|\s)([.:;!?])(?:\s+\1){2,}") * P.PENALTY_REPEATED_MARK
                + n(r"\b[A-Z]{2,}\b") * P.PENALTY_CAPITALS
                + F.when(lower.contains("changelog"), P.PENALTY_CHANGELOG).otherwise(0.0)
                + F.when(lower.rlike(r"\bnewest\s+games\s+like\b"), P.PENALTY_GAMES_PHRASE).otherwise(0.0)
                + F.when((letters > 0) & (letters / dense < P.PENALTY_LEAST_LETTERS), P.PENALTY_FEW_LETTERS).otherwise(0.0)
                + late * P.PENALTY_TITLE_RUN
                + above(titles, P.PENALTY_FREE_TITLES, P.PENALTY_TITLES)
                + above(among(P.CONNECTORS), P.PENALTY_FREE_CONNECTORS, P.PENALTY_CONNECTORS)
                + above(among(P.INTENSIFIERS), P.PENALTY_FREE_INTENSIFIERS, P.PENALTY_INTENSIFIERS)
            )

        found = F.struct(left(t, r"(?U)\s+").alias("dense"), left(t, r"\P{L}+").alias("letters"), left(t, r"[\s\p{L}\p{N}.,;:!?\"'()-]+").alias("symbols"))
        return F.when(t == "", P.PENALTY_BLANK).otherwise(once(found, total_))

    stripped = lambda t: once(F.struct(t.alias("t"), F.lower(t).alias("lower"), worded(t).alias("w")), lambda x: once(F.struct(x["t"].alias("t"), x["lower"].alias("lower"), x["w"].alias("w"), titled(x["w"]).alias("flags")), of))
    return once(strip(text), stripped)
