"""Token cleaning as Column functions.

Everything here returns a ``Column`` built from Spark built-ins and
higher-order functions, so the whole cleaning chain runs inside the JVM and
composes into any projection.

Tokenizer (re-aimed T1): lowercase the text, then take maximal word runs
(non-space, non-punctuation characters, joined by inner ``. / - _`` as in
``2.0``, ``src/a.ts``, ``well-known``) and maximal runs of ASCII punctuation
as tokens. Differences from a Treebank tokenizer: contractions split at the
apostrophe (``don't`` -> ``don`` ``'`` ``t``), quotes stay as they are, a
run like ``--`` or ``...`` stays one token, and other inner punctuation
(``a,b``, ``x:y``) splits.

Lemmatizer (re-aimed T7): an exception table, then noun suffix rules applied
to alphabetic tokens longer than three characters: ``ies -> y``; ``(ch|sh|x|z|ss)es``
drops ``es``; ``men -> man``; a final ``s`` is dropped unless it follows
``s``, ``u`` or ``i``. Verb forms are left alone (``fixed`` stays).
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the cleaning rules being reproduced).
# Standard English stop-word list (179 words), in its usual order.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your "
    "yours yourself yourselves he him his himself she she's her hers herself it "
    "it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn "
    "couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't "
    "isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't "
    "shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
# Corpus additions to the stop words: thanks, thank, lgtm and the two quote tokens.
EXTRA_STOP_WORDS = ["thanks", "thank", "lgtm", "``", "''"]
# Punctuation set; a token is dropped when it is a substring of this string.
PUNCTUATION = string.punctuation  # !"#$%&'()*+,-./:;<=>?@[\]^_`{|}~
# Words that mark a bug-fix title, and words that disqualify it.
FIX_WORDS = ["fix"]
FIX_EXCLUDED_WORDS = ["typo"]
# Constant prefix of an issue title segment (no space after the colon).
ISSUE_TITLE_PREFIX = "Issue title:"
# Separator between record segments.
SEGMENT_SEPARATOR = " | "
# ---------------------------------------------------------------------------

STOP_WORDS = ENGLISH_STOP_WORDS + EXTRA_STOP_WORDS

# Irregular nouns looked up before the suffix rules (our own small table).
LEMMA_EXCEPTIONS = {
    "children": "child",
    "people": "person",
    "men": "man",
    "women": "woman",
    "mice": "mouse",
    "feet": "foot",
    "teeth": "tooth",
    "geese": "goose",
    "indices": "index",
    "matrices": "matrix",
    "vertices": "vertex",
    "analyses": "analysis",
    "axes": "axis",
    "data": "data",
    "series": "series",
    "species": "species",
}

# Whitespace class written out so Java regex and RE2 agree (both lack \v in \s).
_WS = "\\t\\n\\x0B\\f\\r "
# ASCII punctuation as ranges: ! to /, : to @, [ to `, { to ~.
_PUNCT_CLASS = "!-/:-@\\[-`{-~"
# A word run may hold inner . / - _ between word characters (2.0, src/a.ts,
# well-known, snake_case); other punctuation runs are tokens of their own.
_WORD = f"[^{_WS}{_PUNCT_CLASS}]+"
# Portable form (explicit ranges; used by the SQL oracle).
TOKEN_PATTERN = f"{_WORD}(?:[./_-]{_WORD})*|[{_PUNCT_CLASS}]+"
# The same sets in Java's fast classes: \s is exactly [ \t\n\x0B\f\r] and
# \p{Punct} is exactly the ASCII punctuation above (about 3x faster).
JAVA_TOKEN_PATTERN = "[^\\s\\p{Punct}]+(?:[./_-][^\\s\\p{Punct}]+)*|\\p{Punct}+"
# Suffix rules apply to alphabetic tokens only; other tokens stay as they are.
ALPHA_PATTERN = "^[a-z]+$"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_ONLY_PATTERN = "^[\\x00-\\x7F]*$"
SYMBOL_PATTERN = "^[\\p{So}\\p{Sm}\\p{Sk}\\p{Sc}]$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokenize(text) -> Column:
    """T1 + T2: lowercase, then split into word and punctuation runs."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(JAVA_TOKEN_PATTERN), 0)


def drop_punctuation(tokens) -> Column:
    """Drop tokens that are a substring of the punctuation string."""
    return F.filter(_col(tokens), lambda t: F.instr(F.lit(PUNCTUATION), t) == 0)


def is_ascii(t: Column) -> Column:
    """Only ASCII characters <=> as many UTF-8 bytes as characters (no regex)."""
    return F.length(t) == F.octet_length(t)


def keep_ascii(tokens) -> Column:
    """T4: keep tokens made only of ASCII characters."""
    return F.filter(_col(tokens), is_ascii)


def drop_stop_words(tokens, stop_words=None) -> Column:
    """T5: drop stop words, keeping order and duplicates of the rest.
    ``isin`` over many literals becomes a hash-set lookup (InSet)."""
    stops = stop_words if stop_words is not None else STOP_WORDS
    return F.filter(_col(tokens), lambda t: ~t.isin(*stops))


def drop_symbols(tokens) -> Column:
    """Drop single-character symbols (Unicode So, Sm, Sk, Sc); the
    pattern only runs on one-character tokens."""
    return F.filter(_col(tokens), lambda t: (F.length(t) != 1) | ~t.rlike(SYMBOL_PATTERN))


def lemma(token: Column, exceptions: dict | None = None) -> Column:
    """T7 for one token: exception table, then noun suffix rules (suffix
    tests and substrings, no regular expressions in the hot path)."""
    exceptions = LEMMA_EXCEPTIONS if exceptions is None else exceptions
    n = F.length(token)
    es_plural = (token.endswith("ches") | token.endswith("shes") | token.endswith("xes")
                 | token.endswith("zes") | token.endswith("sses"))
    plain_s = ~token.endswith("ss") & ~token.endswith("us") & ~token.endswith("is")
    suffixed = F.when(token.endswith("ies"), F.concat(F.substring(token, 1, n - 3), F.lit("y"))) \
                .when(es_plural, F.substring(token, 1, n - 2)) \
                .when(token.endswith("men"), F.concat(F.substring(token, 1, n - 3), F.lit("man"))) \
                .when(token.endswith("s") & plain_s, F.substring(token, 1, n - 1)) \
                .otherwise(token)
    # Cheap suffix test first; the alphabetic test (deleting a-z leaves
    # nothing) runs once, and only on candidates.
    candidate = (token.endswith("s") | token.endswith("men")) & (n > 3)
    rules = F.when(candidate & (F.translate(token, _LOWER, "") == ""), suffixed).otherwise(token)
    if not exceptions:
        return rules
    table = F.create_map(*[x for kv in exceptions.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.when(token.isin(*exceptions.keys()), F.try_element_at(table, token)).otherwise(rules)


def lemmatize(tokens, exceptions: dict | None = None) -> Column:
    """T7 over an array of tokens."""
    return F.transform(_col(tokens), lambda t: lemma(t, exceptions))


def clean_tokens(text, stop_words=None, symbols: bool = True, lemmas: bool = True) -> Column:
    """The whole cleaning chain, string -> array<string>.

    NULL text gives NULL; an empty text gives an empty array.
    """
    toks = tokenize(text)
    stops = stop_words if stop_words is not None else STOP_WORDS

    def keep(t):
        cond = (F.instr(F.lit(PUNCTUATION), t) == 0) & is_ascii(t) & ~t.isin(*stops)
        if symbols:  # T6 in the same pass; the pattern only runs on 1-char tokens
            cond = cond & ((F.length(t) != 1) | ~t.rlike(SYMBOL_PATTERN))
        return cond

    toks = F.filter(toks, keep)
    if lemmas:
        toks = lemmatize(toks)
    return toks


def join_tokens(tokens, sep: str = " ") -> Column:
    """Join a token bag with a space."""
    return F.array_join(_col(tokens), sep)


def first_line(text) -> Column:
    """First line of a message."""
    return F.substring_index(_col(text), "\n", 1)


def is_fix_title(tokens, wanted=None, excluded=None) -> Column:
    """lemma tokens contain a wanted word and none of the excluded words."""
    wanted = FIX_WORDS if wanted is None else wanted
    excluded = FIX_EXCLUDED_WORDS if excluded is None else excluded
    t = _col(tokens)
    cond = F.lit(False)
    for w in wanted:
        cond = cond | F.array_contains(t, w)
    return cond & ~F.arrays_overlap(t, _lit_array(excluded))


def is_bot_comment(first_paragraph, phrase_pairs) -> Column:
    """a comment is a bot post when its first paragraph holds both phrases
    of any pair. ``phrase_pairs`` is a list of (a, b) tuples."""
    p = _col(first_paragraph)
    cond = F.lit(False)
    for a, b in phrase_pairs:
        cond = cond | (F.coalesce(p.contains(a) & p.contains(b), F.lit(False)))
    return cond


def prefixed(prefix: str, text) -> Column:
    """Constant prefix, no separator."""
    return F.concat(F.lit(prefix), _col(text))
