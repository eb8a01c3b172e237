"""HTML extraction Column functions (P6, P7, P10, P11), all in the JVM.

A page is cut into tokens by one pattern (``TOKEN``): comments, declarations,
script and style elements with their raw text, tags whose quoted attribute values
may hold ``>``, and text. An automaton runs over the tags as one ``aggregate``
(``spans``): a stack of open elements by name, from which an end tag takes all up to
its own start, void elements that never open, and the standard's implied ends
(a paragraph ends at the next block, a list item at the next item). Runs of equal
names are one entry of the stack, so a page that never closes its tags costs no more.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities decoded after tag stripping; '&amp;' goes last.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"),
]

# ---------------------------------------------------------------------------
# Fixed values of the HTML standard: elements without an end tag, elements whose text
# is not markup, and which open elements a start tag ends unless one of the stops is
# opened after them.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
RAW = "script|style"
PLAIN = "title|textarea"
BLOCKS = ("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
          "header hgroup hr li dd dt main menu nav ol p pre search section summary table ul").split()
ENDS = {**{b: ["p"] for b in BLOCKS}, "li": ["p", "li"], "dd": ["p", "dd", "dt"], "dt": ["p", "dd", "dt"], "tr": ["td", "th", "tr"],
        "td": ["td", "th"], "th": ["td", "th"], "tbody": ["td", "th", "tr", "thead", "tbody"], "tfoot": ["td", "th", "tr", "thead", "tbody"],
        "option": ["option"], "optgroup": ["option", "optgroup"]}
STOPS = {**{b: ["table", "td", "th", "caption", "button", "object", "template"] for b in BLOCKS},
         "li": ["ul", "ol", "menu", "table", "td", "th", "button", "object", "template"],
         **{x: ["dl", "table", "td", "th", "button", "object", "template"] for x in ("dd", "dt")},
         **{x: ["table", "template"] for x in ("tr", "td", "th", "tbody", "tfoot")}, "option": ["select", "datalist"], "optgroup": ["select"]}
# ---------------------------------------------------------------------------
# Attributes up to the end of a tag: a quote opens a value only after '='. Every
# repetition is possessive, so no tag is too long for the pattern.
_ATTRS = r"""(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+"""
TAG_PATTERN = rf"</?[a-zA-Z]{_ATTRS}>"
TOKEN = (rf"(?si)<!--.*?(?:-->|\z)|<({RAW}|{PLAIN})(?=[\s/>]){_ATTRS}>.*?(?=</\1[\s/>]|\z)|<[!?][^>]*+>|</?[a-z]{_ATTRS}>"
         r"|(?:[^<]++|<(?![a-z/!?]))++|<")
_NAME = r"^</?([a-zA-Z][^\s/>]*)"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]++)"""


_numbers = count()


def once(value: Column, use) -> Column:
    """``use(value)`` of any column, with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _text(html) -> str:
    """SQL text of a column's name or of a result of this module."""
    if isinstance(html, str):
        return "`" + html.replace("`", "``").replace(".", "`.`") + "`"
    made = vars(html).get("_sql")
    if made is None:
        raise TypeError("give a column's name or a result of functions.html")
    return made


def _column(sql: str) -> Column:
    column = F.expr(sql)
    column._sql = sql
    return column


def _lit(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fn(body) -> str:
    """A lambda function of one argument, whose name is used once."""
    x = f"v{next(_numbers)}"
    return f"{x} -> {body(x)}"


def _let(value: str, body) -> str:
    """``body(value)`` with the value computed once, however often it is used."""
    return f"get(transform(array({value}), {_fn(body)}), 0)"


def _replace(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {_lit(pattern)}, {_lit(by)})"


def _unescape(text: str) -> str:
    """Numeric references, then the named entities; '&amp;' goes last."""
    pattern = _lit("&#([0-9]{1,8}|[xX][0-9a-fA-F]{1,8});")

    def character(d):
        code = f"try_cast(CASE WHEN lower(left({d}, 1)) = 'x' THEN conv(substr({d}, 2, 8), 16, 10) ELSE substr({d}, 1, 8) END AS BIGINT)"
        return _let(code, lambda c: f"decode(unhex(lpad(hex(CASE WHEN {c} BETWEEN 1 AND 55295 OR {c} BETWEEN 57344 AND 1114111 THEN {c} "
                                    "ELSE 65533 END), 8, '0')), 'UTF-32')")

    def all_of(c):
        gaps = (f"array_join(zip_with(split({c}, {pattern}, -1), transform(regexp_extract_all({c}, {pattern}, 1), {_fn(character)}), "
                "(gap, sign) -> concat(gap, coalesce(sign, ''))), '')")
        out = f"CASE WHEN instr({c}, '&#') > 0 THEN {gaps} ELSE {c} END"
        for entity, sign in ENTITIES:
            out = f"replace({out}, {_lit(entity)}, {_lit(sign)})"
        return out
    return _let(text, lambda c: f"CASE WHEN instr({c}, '&') > 0 THEN {all_of(c)} ELSE {c} END")


def unescape(text) -> Column:
    """Text with its character references decoded."""
    return _column(_unescape(_text(text)))


# ------------------------------------------------------------------ tokens

def _tokens(html: str) -> str:
    return f"regexp_extract_all({html}, {_lit(TOKEN)}, 0)"


def tokens(html) -> Column:
    """The page's tokens in order; joined they are the page again."""
    return _column(_tokens(_text(html)))


def _key_pattern(key: str) -> str:
    """A start tag up to an attribute's name, past all other attributes."""
    return rf"(?si)^<[^\s/>]++(?:[\s/]++(?!{key}[\s=/>])[^\s=>/]++(?:\s*+=\s*+{_VALUE})?+)*+[\s/]++{key}"


def _attribute(token: str, key: str) -> str:
    pattern = _key_pattern(key) + rf"\s*+=\s*+({_VALUE})"
    return _unescape(_replace(f"regexp_extract({token}, {_lit(pattern)}, 1)", "^[\"']|[\"']$"))


def _has_attribute(token: str, key: str) -> str:
    return f"{token} RLIKE {_lit(_key_pattern(key) + '[\\s=/>]')}"


def attribute(token, key: str) -> Column:
    """The value of an attribute of a start tag, '' if it has none."""
    return _column(_attribute(_text(token), key))


def has_attribute(token, key: str) -> Column:
    return _column(_has_attribute(_text(token), key))


def start_tag(tag: str, css_class: str | None = None, class_pattern: str | None = None, **attrs):
    """A test of tokens: start tags of that name that have the class among others (a
    class of several words: these in a row), a class that matches a pattern, and
    attributes of given values (True: of any; ``data_x`` stands for ``data-x``)."""
    def test(token: str) -> str:
        # AND stops at the first test that fails: the name.
        ok = [f"{token} RLIKE {_lit(rf'(?i)^<{tag}[\s/>]')}"]
        if css_class is not None:
            words = _replace(_attribute(token, "class"), "[ \\t\\n\\f\\r]+", " ")
            ok.append(f"instr(concat(' ', {words}, ' '), {_lit(f' {css_class} ')}) > 0")
        if class_pattern is not None:
            ok.append(f"{_attribute(token, 'class')} RLIKE {_lit(class_pattern)}")
        for key, value in attrs.items():
            key = key.replace("_", "-")
            ok.append(_has_attribute(token, key) if value is True else f"{_attribute(token, key)} = {_lit(value)}")
        return "(" + " AND ".join(ok) + ")"
    return test


#: Tokens of one run of the automaton, which the next run goes on from. Every tag copies the
#: state, so what earlier runs have found is not in it.
CHUNK = 256
_STACK, _OPEN, _SPANS = "array<struct<name:string,base:int>>", "array<struct<at:int,depth:int,code:int>>", "array<struct<first:int,last:int,code:int>>"


def _listed(names) -> str:
    return f"split('{' '.join(names)}', ' ')"


def _table(rules: dict) -> str:
    """A map literal of words, from one string: few expressions to analyze, folded once."""
    return "str_to_map('" + ";".join(f"{k}:{' '.join(v)}" for k, v in rules.items()) + "', ';', ':')"


def _marks(parts: str, tests, before: str) -> str:
    """The tags among the tokens: place (``before`` tokens are before these), name, and what the automaton asks of them
    (``code``: the number of the first test that a start tag passes)."""
    code = "CASE " + " ".join(f"WHEN {test('t')} THEN {k}" for k, test in enumerate(tests)) + " END"
    rule = lambda rules, n: f"split(try_element_at({_table(rules)}, {n}), ' ')"
    mark = _let(f"lower(regexp_extract(t, {_lit(_NAME)}, 1))", lambda n: (
        f"CASE WHEN {n} != '' THEN named_struct('at', i + {before}, 'name', {n}, 'closing', startswith(t, '</'), "
        f"'empty', array_contains({_listed(VOID)}, {n}) OR endswith(t, '/>'), "
        f"'ends', {rule(ENDS, n)}, 'stops', {rule(STOPS, n)}, 'code', {code}) END"))
    return f"filter(transform({parts}, (t, i) -> CASE WHEN startswith(t, '<') THEN {mark} END), m -> m IS NOT NULL)"


def _taken() -> str:
    """Place in the stack (1: the top) of the element that tag m ends, 0: none."""
    names, x, i = "s.stack.name", f"v{next(_numbers)}", f"v{next(_numbers)}"
    # The lowest one above the first stop: an item ends with the paragraph in it.
    stop = f"nullif(int(array_position(transform({names}, {x} -> array_contains(m.stops, {x})), true)), 0)"
    above = f"slice({names}, 1, coalesce({stop} - 1, size({names})))"
    lowest = f"coalesce(array_max(transform({above}, ({x}, {i}) -> CASE WHEN array_contains(m.ends, {x}) THEN {i} + 1 END)), 0)"
    return (f"CASE WHEN m.closing THEN int(array_position({names}, m.name)) "
            f"WHEN m.ends IS NOT NULL THEN {lowest} ELSE 0 END")


def _popped(i: str) -> str:
    """Depth and stack once the element at place i has ended."""
    depth = f"CASE WHEN {i} = 0 THEN s.depth ELSE coalesce(get(s.stack, {i} - 2).base, s.depth) - 1 END"
    return _let(depth, lambda d: (
        f"named_struct('depth', {d}, 'stack', CASE WHEN {i} = 0 THEN s.stack "
        f"ELSE slice(s.stack, CASE WHEN {d} > get(s.stack, {i} - 1).base THEN {i} ELSE {i} + 1 END, size(s.stack)) END)"))


def _opened(p: str) -> str:
    """The state after tag m, p being depth and stack after what it ends."""
    opens, ended = "NOT m.closing AND NOT m.empty", f"get(s.open, 0).depth > {p}.depth"
    done = (f"CASE WHEN {ended} THEN concat(s.done, transform(filter(s.open, o -> o.depth > {p}.depth), "
            f"o -> named_struct('first', o.at, 'last', m.at, 'code', o.code))) ELSE s.done END")
    still = f"CASE WHEN {ended} THEN filter(s.open, o -> o.depth <= {p}.depth) ELSE s.open END"
    stack = (f"CASE WHEN {opens} AND NOT coalesce(get({p}.stack, 0).name = m.name, false) "
             f"THEN concat(array(named_struct('name', m.name, 'base', {p}.depth)), {p}.stack) ELSE {p}.stack END")
    new = f"CASE WHEN {opens} AND m.code IS NOT NULL THEN concat(array(named_struct('at', m.at, 'depth', {p}.depth + 1, 'code', m.code)), {still}) ELSE {still} END"
    found = (f"CASE WHEN NOT m.closing AND m.empty AND m.code IS NOT NULL "
             f"THEN concat({done}, array(named_struct('first', m.at, 'last', m.at + 1, 'code', m.code))) "
             f"ELSE {done} END")
    return (f"named_struct('depth', CASE WHEN {opens} THEN {p}.depth + 1 ELSE {p}.depth END, 'stack', CAST({stack} AS {_STACK}), "
            f"'open', CAST({new} AS {_OPEN}), 'done', CAST({found} AS {_SPANS}))")


def _spans(parts: str, *tests) -> str:
    """(first, last, code) token numbers of the elements whose start tag passes a test, in
    order of their start: the start tag, and the first token that is not inside."""
    tags = _marks(f"slice({parts}, c * {CHUNK} + 1, {CHUNK})", tests, f"c * {CHUNK}")
    step = _let(_taken(), lambda i: _let(_popped(i), _opened))
    state = lambda depth, stack, opened: f"named_struct('depth', {depth}, 'stack', {stack}, 'open', {opened}, 'done', CAST(array() AS {_SPANS}))"
    none = state("0", f"CAST(array() AS {_STACK})", f"CAST(array() AS {_OPEN})")
    chunk = f"aggregate({tags}, {state('w.now.depth', 'w.now.stack', 'w.now.open')}, (s, m) -> {step})"
    return (f"array_sort(aggregate(sequence(0, int(size({parts}) div {CHUNK})), named_struct('now', {none}, 'done', CAST(array() AS {_SPANS})), "
            f"(w, c) -> named_struct('now', {chunk}, 'done', concat(w.done, w.now.done)), "
            f"w -> concat(w.done, w.now.done, transform(w.now.open, o -> named_struct('first', o.at, 'last', size({parts}), 'code', o.code)))))")


def _texts(parts: str) -> str:
    """Text nodes of tokens, entities decoded: no tags, comments, scripts or styles."""
    kept = f"filter({parts}, t -> NOT t RLIKE {_lit('^<(?:[a-zA-Z!?]|/[a-zA-Z])')} OR t RLIKE {_lit(rf'(?i)^<(?:{PLAIN})[\s/>]')})"
    return f"transform({kept}, {_fn(lambda t: _unescape(_replace(t, rf'(?si)^<(?:{PLAIN})(?=[\s/>]){_ATTRS}>')))})"


def text_of(parts: str) -> str:
    """Text nodes with a space between (they never fuse), white space collapsed, trimmed."""
    return f"trim({_replace(f'array_join({_texts(parts)}, {_lit(' ')})', '[\\t\\n\\x0B\\f\\r ]+', ' ')})"


def lines_of(parts: str) -> str:
    """Text nodes that are not blank, one a line, stripped."""
    stripped = f"transform({_texts(parts)}, {_fn(lambda t: _replace(t, '(?U)^\\s+|\\s+$'))})"
    return f"array_join(filter({stripped}, t -> t != ''), '\\n')"


def _inside(parts: str, span: str) -> str:
    """The tokens of an element; its start tag counts only for the text it may hold."""
    return f"slice({parts}, {span}.first + 1, {span}.last - {span}.first)"


def _element_text(parts: str, span: str) -> str:
    return text_of(_inside(parts, span))


def _markup(parts: str, span: str) -> str:
    """Inner HTML: what the start tag's token holds beyond the tag, and the tokens inside."""
    own = _replace(f"get({parts}, {span}.first)", f"(?s)^{TAG_PATTERN}")
    return f"concat({own}, array_join(slice({parts}, {span}.first + 2, greatest({span}.last - {span}.first - 1, 0)), ''))"


def _inner(parts: str, span: str) -> str:
    """The tokens of the inner HTML, cut anew only where they could be others: in the text of
    the start tag's token, and where the page has an unfinished tag."""
    own = _replace(f"get({parts}, {span}.first)", f"(?s)^{TAG_PATTERN}")
    some = f"slice({parts}, {span}.first + 2, greatest({span}.last - {span}.first - 1, 0))"
    return _let(f"named_struct('own', {own}, 'some', {some})", lambda x: (
        f"CASE WHEN {x}.own != '' OR array_contains({x}.some, '<') THEN {_tokens(f"concat({x}.own, array_join({x}.some, ''))")} ELSE {x}.some END"))


def _scripts(parts: str, wanted) -> str:
    return f"transform(filter({parts}, {_fn(wanted)}), {_fn(lambda t: _replace(t, f'(?s)^{TAG_PATTERN}'))})"


def _first(html: str, wanted, made) -> str:
    return _let(_tokens(html), lambda parts: _let(f"get({_spans(parts, wanted)}, 0)", lambda span: (
        f"CASE WHEN {span} IS NOT NULL THEN {made(parts, span)} WHEN {parts} IS NOT NULL THEN '' END")))


def _every(html: str, wanted, made) -> str:
    return _let(_tokens(html), lambda parts: f"transform({_spans(parts, wanted)}, {_fn(lambda span: made(parts, span))})")


# --------------------------------------------------------------- functions

def strip_tags(fragment) -> Column:
    """The text of a fragment, on one line."""
    return _column(_let(_tokens(_text(fragment)), text_of))


def lines(fragment) -> Column:
    """The text nodes of a fragment that are not blank, one a line, without white space
    of any script at either end."""
    return _column(lines_of(_tokens(_text(fragment))))


def _before(text: str, separator: str) -> str:
    return _let(text, lambda t: f"CASE WHEN instr({t}, {_lit(separator)}) > 0 THEN trim(substring_index({t}, {_lit(separator)}, 1)) ELSE '' END")


def title_before(html, separator: str = "·") -> Column:
    """<title> text; if it contains the separator, the trimmed part before
    the first separator, else ''."""
    return _column(_before(_first(_text(html), start_tag("title"), _element_text), separator))


def first_element(html, wanted) -> Column:
    """Inner HTML of the first element whose start tag passes the test, '' if there is none."""
    return _column(_first(_text(html), wanted, _markup))


def all_elements(html, wanted) -> Column:
    """Inner HTML of each element whose start tag passes the test, nested ones too, by their start."""
    return _column(_every(_text(html), wanted, _markup))


def element_html(html, tag: str, css_class: str | None = None) -> Column:
    """Inner HTML of the first <tag> (with the given class)."""
    return first_element(html, start_tag(tag, css_class))


def element_text(html, tag: str, css_class: str | None = None, **attrs) -> Column:
    """Text of the first element with a tag and class, stripped."""
    return _column(_first(_text(html), start_tag(tag, css_class, **attrs), _element_text))


def element_texts(html, wanted) -> Column:
    """Text of each element whose start tag passes the test, by their start."""
    return _column(_every(_text(html), wanted, _element_text))


def all_texts(html, places=(), **tests) -> Column:
    """One struct with an array (first, last, text) for each named test: the elements whose
    start tag passes it and none of the tests before it, all found in one run of the
    automaton. Names in ``places`` get no text."""
    def fields(parts, found):
        out = []
        for k, name in enumerate(tests):
            text = "''" if name in places else _element_text(parts, "e")
            out.append(f"'{name}', transform(filter({found}, e -> e.code = {k}), e -> named_struct('first', e.first, 'last', e.last, 'text', {text}))")
        return f"named_struct({', '.join(out)})"
    return _column(_let(_tokens(_text(html)), lambda parts: _let(_spans(parts, *tests.values()), lambda found: fields(parts, found))))


def first(test, use=_element_text, none: str = "''"):
    """For ``parts``: ``use`` of the first element whose start tag passes the test, ``none`` (SQL) if there is none."""
    return test, lambda parts, found: _let(f"get({found}, 0)", lambda span: (
        f"CASE WHEN {span} IS NOT NULL THEN {use(parts, span)} WHEN {parts} IS NOT NULL THEN {none} END"))


def every(test, use=_element_text):
    """For ``parts``: ``use`` of each element whose start tag passes the test, nested ones too, by their start."""
    return test, lambda parts, found: f"transform({found}, {_fn(lambda span: use(parts, span))})"


def title(separator: str = "·"):
    """For ``parts``: ``title_before``."""
    test, made = first(start_tag("title"))
    return test, lambda parts, found: _before(made(parts, found), separator)


def script_texts(wanted):
    """For ``parts``: ``scripts``."""
    return None, lambda parts, _: _scripts(parts, wanted)


def inner(use, empty: bool = True):
    """For ``first`` and ``every``: ``use`` (``text_of``, ``lines_of``, ``paragraphs_of``) of the
    tokens of the inner HTML; NULL of none if not ``empty``."""
    return lambda parts, span: _let(_inner(parts, span), lambda x: use(x) if empty else f"CASE WHEN size({x}) > 0 THEN {use(x)} END")


def inside(wanted, use=_element_text, none: str = "''"):
    """For ``first`` and ``every``: ``first`` in the inner HTML, taken as a page of its own."""
    return lambda parts, span: _let(_inner(parts, span), lambda x: first(wanted, use, none)[1](x, _spans(x, wanted)))


def paragraphs_of(wanted=start_tag("p")):
    """For ``inner``: ``paragraphs``."""
    return lambda tokens: f"filter(transform({_spans(tokens, wanted)}, {_fn(lambda e: _element_text(tokens, e))}), t -> t != '')"


def parts(html, **wanted) -> Column:
    """One struct with a field for each name: what ``first``, ``every``, ``title`` or ``script_texts``
    asks of the page. The page is cut into tokens once and the automaton runs over them once; no
    start tag may pass the tests of two fields."""
    tests = [test for test, _ in wanted.values() if test]

    def fields(tokens, found):
        code, out = count(), []
        for name, (test, made) in wanted.items():
            mine = f"filter({found}, {_fn(lambda e: f'{e}.code = {next(code)}')})" if test else ""
            out.append(f"'{name}', {made(tokens, mine)}")
        return f"named_struct({', '.join(out)})"
    return _column(_let(_tokens(_text(html)), lambda tokens: _let(_spans(tokens, *tests), lambda found: fields(tokens, found))))


def each(fragments, use) -> Column:
    """An array of this module's results with ``use`` (functions of this module) applied to each."""
    def body(x):
        column = F.lit(None)
        column._sql = x
        return _text(use(column))
    return _column(f"transform({_text(fragments)}, {_fn(body)})")


def chosen(markup, test, use) -> Column:
    """``use`` (a function of this module) of a result that passes a test, else NULL."""
    def body(x):
        column = F.lit(None)
        column._sql = x
        return f"CASE WHEN {test(x)} THEN {_text(use(column))} END"
    return _column(_let(_text(markup), body))


def paragraphs(fragment, wanted=start_tag("p")) -> Column:
    """P11 parts: text of each <p> in a fragment. A paragraph ends at its end tag, at
    the next block, or with the element it stands in. Empty ones are dropped."""
    return _column(f"filter({_text(element_texts(fragment, wanted))}, t -> t != '')")


def comment_text(fragment) -> Column:
    """Non-empty paragraphs joined by a newline."""
    return F.array_join(paragraphs(fragment), "\n")


def tag_texts(html, tag: str = "a") -> Column:
    """P10: distinct inner texts of an inline tag, sorted."""
    return F.array_sort(F.array_distinct(element_texts(html, start_tag(tag))))


def scripts(html, wanted) -> Column:
    """Raw text of the script elements whose start tag passes the test."""
    return _column(_scripts(_tokens(_text(html)), wanted))
