"""Boolean trigram queries that every match of a regular expression satisfies."""

from __future__ import annotations

from re import _parser as parser

from re import _constants as c

#: More strings than this for one part of a pattern count as any.
MANY = 32


def _texts(tree) -> frozenset[str] | None:
    """All strings that tree matches, lower-cased, or None for too many."""
    now = frozenset([""])
    for op, arg in tree:
        if op is c.LITERAL:
            more = {chr(arg).lower()}
        elif op is c.IN:
            more = set()
            for kind, x in arg:
                if kind is c.LITERAL:
                    more.add(chr(x).lower())
                elif kind is c.RANGE and x[1] - x[0] < MANY:
                    more |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
                else:
                    return None
        elif op is c.BRANCH:
            parts = [_texts(x) for x in arg[1]]
            if None in parts:
                return None
            more = frozenset().union(*parts)
        elif op is c.SUBPATTERN:
            more = _texts(arg[3])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[1] <= 4:
            each = _texts(arg[2])
            if each is None:
                return None
            more, power = set(), frozenset([""])
            for n in range(arg[1] + 1):
                if n >= arg[0]:
                    more |= power
                power = frozenset(a + b for a in power for b in each) if len(power) * len(each) <= MANY else None
                if power is None:
                    return None
        else:
            return None
        if more is None or len(now) * len(more) > MANY:
            return None
        now = frozenset(a + b for a in now for b in more)
    return now


def _clause(texts: frozenset[str] | None) -> frozenset[frozenset[str]] | None:
    """Alternatives, each a set of trigrams that must all be there; None if some text has no trigram."""
    if not texts or any(len(t) < 3 for t in texts):
        return None
    alternatives = {frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts}
    return frozenset(a for a in alternatives if not any(b < a for b in alternatives))


def clauses(tree) -> list[frozenset[frozenset[str]]]:
    """Clauses that must all hold of the lower-cased text; each holds if one of its alternatives does."""
    out, run = [], []

    def flush() -> None:
        if run:
            # A longer run of parts knows more, as long as its strings can be listed.
            made = _clause(_texts(run))
            if made is None:
                for part in run:
                    if (one := _clause(_texts([part]))) is not None:
                        out.append(one)
            else:
                out.append(made)
            run.clear()

    for op, arg in tree:
        if _texts([(op, arg)]) is not None:
            if _texts([*run, (op, arg)]) is None:
                flush()
            run.append((op, arg))
            continue
        flush()
        if op is c.SUBPATTERN:
            out += clauses(arg[3])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] >= 1:
            out += clauses(arg[2])
    flush()
    return list(dict.fromkeys(out))


def query(pattern: str) -> list[frozenset[frozenset[str]]]:
    """As clauses(); empty if the pattern has no mandatory trigram."""
    return clauses(parser.parse(pattern))
