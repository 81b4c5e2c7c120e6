"""Boolean trigram queries derived from regular expressions.

A query is True (anything may match), a trigram, or ("and" | "or", frozenset of queries). A text can
match the expression only if its lower-cased trigrams satisfy the query.
"""

from __future__ import annotations

from re import _constants as sre  # the standard library's parser names
from re import _parser

#: Alternatives that a fixed piece may have before it is cut into trigrams, and letters of a class that are spelled out.
MOST, CLASS = 24, 8


def both(a: object, b: object) -> object:
    return _join("and", a, b)


def either(a: object, b: object) -> object:
    if a is True or b is True:
        return True
    parts = set().union(*(x[1] if isinstance(x, tuple) and x[0] == "or" else {x} for x in (a, b)))
    least = [p for p in parts if not any(_holds(p) > _holds(q) for q in parts)]  # A or (A and B) is A
    return least[0] if len(least) == 1 else ("or", frozenset(least))


def _holds(query: object) -> frozenset:
    return query[1] if isinstance(query, tuple) and query[0] == "and" else frozenset([query])


def _join(kind: str, a: object, b: object) -> object:
    if a is True:
        return b
    if b is True or a == b:
        return a
    parts = set()
    for x in (a, b):
        parts |= x[1] if isinstance(x, tuple) and x[0] == kind else {x}
    return (kind, frozenset(parts))


def _spelled(strings: set[str]) -> object:
    """What a text must hold if it holds one of these strings."""
    query: object = None
    for s in strings:
        one: object = True
        for i in range(len(s) - 2):
            one = both(one, s[i : i + 3])
        query = one if query is None else either(query, one)
    return True if query is None else query


def derive(pattern: str) -> object:
    """The trigram query of a regular expression; True where it has no mandatory trigram."""
    exact, query = _sequence(list(_parser.parse(pattern)))
    return both(query, _spelled(exact) if exact is not None else True)


def _sequence(items: list) -> tuple[set[str] | None, object]:
    """Strings that the whole sequence is limited to (None: unlimited), and a query that holds besides."""
    whole: set[str] | None = {""}
    run: set[str] = {""}  # fixed strings right before the current place
    query: object = True
    for op, arg in items:
        exact, own = _node(op, arg)
        query = both(query, own)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
            continue
        query = both(query, _spelled(run))
        if exact is not None:
            query = both(query, _spelled(exact))
            run = {s[-2:] for s in exact}
            run = run if len(run) <= MOST else {""}
        else:
            run = {""}
        whole = None
    if whole is None:
        return None, both(query, _spelled(run))
    return run, query


def _node(op: object, arg: object) -> tuple[set[str] | None, object]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, True
    if op is sre.IN:
        letters = [chr(v).lower() for k, v in arg if k is sre.LITERAL]
        return (set(letters), True) if len(letters) == len(arg) <= CLASS else (None, True)
    if op is sre.SUBPATTERN:
        return _sequence(list(arg[-1]))
    if op is sre.BRANCH:
        found = [_sequence(list(x)) for x in arg[1]]
        if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= MOST and all(q is True for _, q in found):
            return set().union(*(e for e, _ in found)), True
        query: object = None
        for exact, own in found:
            one = both(own, _spelled(exact) if exact is not None else True)
            query = one if query is None else either(query, one)
        return None, query
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = arg
        exact, own = _sequence(list(inner))
        if exact is not None and own is True and most == 1:
            return (exact | {""}, True) if least == 0 else (exact, True)
        if least == 0:
            return None, True
        if exact is not None and own is True and least == most and len(exact) == 1:
            return {next(iter(exact)) * least}, True
        return None, both(own, _spelled(exact) if exact is not None else True)
    if op is sre.AT:
        return {""}, True
    return None, True


#: Characters of text from the most to the least usual; what isn't listed is rarer still.
USUAL = " etaoinsrhldcumfpgwybvkxjqz"


def _rare(trigram: str) -> tuple:
    places = [USUAL.find(c) if c in USUAL else len(USUAL) for c in trigram]
    return -sum(places), trigram


def thinned(query: object, most: int = 2) -> object:
    """A query that follows from ``query`` and names fewer trigrams: of each conjunction's, the ``most`` rarest by their letters."""
    if query is True or isinstance(query, str):
        return query
    kind, parts = query
    own = [thinned(p, most) for p in parts if not isinstance(p, str)]
    plain = sorted((p for p in parts if isinstance(p, str)), key=_rare)
    kept = [*(plain[:most] if kind == "and" else plain), *own]
    out = kept[0]
    for p in kept[1:]:
        out = both(out, p) if kind == "and" else either(out, p)
    return out


def trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def satisfied(query: object, held: set[str]) -> bool:
    if query is True or isinstance(query, str):
        return query is True or query in held
    return (all if query[0] == "and" else any)(satisfied(q, held) for q in query[1])
