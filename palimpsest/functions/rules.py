"""Recognition rules: patterns in a small portable syntax, and their translation to what Spark runs.

A rule's pattern is written in the common subset of regular expressions, with `\\d`, `\\s`, `\\w` meaning Unicode digits,
spaces and word characters, and `\\b` allowed at either end as a boundary between word characters of any script. A match's
span is the whole match or its last group, which then ends the pattern.

Translated patterns have two groups, what stands before the span and the span itself, so that Spark's built-in functions
give both with their lengths. The left boundary also holds where the last match ended: a scan that goes on from there
sees a fresh start of text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Word characters and white space, as insides of a character class. Fixed values.
WORD = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}"
SPACE = r"\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
DIGIT = r"\p{Nd}"
_CLASSES = {"d": DIGIT, "s": SPACE, "w": WORD}
_LEFT, _RIGHT = rf"(?:\G|(?<![{WORD}]))", rf"(?![{WORD}])"
_PIECE = re.compile(r"\\x\{[0-9A-Fa-f]+\}|\\p\{\w+\}|\\.|\[\\s\\S\]|\[|\]|\(\?(?:[:=!]|<[=!])|.", re.S)
#: A class that begins a pattern, and how often it is there at least.
_FIRST = re.compile(r"(\\d|\[[0-9A-Za-z-]+\])(?:\{(\d+)[,}])?+(?![*?])")
_FLAGS = re.compile(r"\(\?([imsU]+)\)")
#: A run of a class that begins a pattern, up to a plain character.
_RUN_FIRST = re.compile(r"(\[[^\\\[\]]+\])\+([^\\\[\](){}|.*+?^$])")
#: Space on both sides of an optional mark; words with space between them.
_OPTIONAL = re.compile(r"\\s\*(\[[^\\\]]*(?:\\-)?\])\?\\s\*(?!\\s|\[:)")
_WORDS = re.compile(r"(\((?:\?:)?)(\[[a-zA-Z0-9-]+\])\+\\s\+\)")


class PatternError(ValueError):
    """A pattern that the translation can't express."""


@dataclass(frozen=True)
class Rule:
    """guards: plain strings of which a text must hold one, in lower case, to be worth a scan; digits: it needs a digit."""

    name: str
    kind: str
    pattern: str
    score: float
    group: int = 0
    guards: tuple[str, ...] = ()
    digits: bool = False


#: Patterns and scores. Fixed values.
RULES = (
    Rule("EMAIL", "EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.90, guards=("@",)),
    Rule("PHONE", "PHONE_NUMBER", r"\+?\d[\d -]{7,}\d", 0.70, digits=True),
    Rule("BANK", "BANK_NUMBER", r"\b\d{12,19}\b", 0.60, digits=True),
    Rule("VCODE", "VERIFICATION_CODE", r"\b\d{4,8}\b", 0.50, digits=True),
    Rule("VCODE_LABELED_ALNUM", "VERIFICATION_CODE", r"(?i)\b(?:verification\s*code|verify\s*code|otp|2fa\s*code|auth(?:entication)?\s*code)\s*[:=\-]?\s*([A-Za-z0-9]{4,12})", 0.80, 1, ("code", "otp")),
    Rule("PASSWORD_LITERAL", "PASSWORD", r"(?i)\bpassword\s*[:=]\s*(\S+)", 0.40, 1, ("password",)),
    Rule("PWD_LITERAL", "PASSWORD", r"(?i)\b(?:pwd|pass|passwd|passcode)\s*[:=]\s*(\S+)", 0.60, 1, ("pwd", "pass")),
    Rule("SEED_PHRASE", "RANDOM_SEED", r"(?i)(seed|mnemonic)\s*[:=]?\s*([a-z]+\s+){11,23}[a-z]+", 0.70, guards=("seed", "mnemonic")),
    Rule("PEM_PRIVKEY", "PRIVATE_KEY", r"-----BEGIN (?:OPENSSH|RSA|EC|DSA) PRIVATE KEY-----[\s\S]*?-----END (?:OPENSSH|RSA|EC|DSA) PRIVATE KEY-----", 0.95, guards=("-----begin ",)),
    Rule("HEX_PRIVKEY", "PRIVATE_KEY", r"\b[0-9a-fA-F]{64}\b", 0.75),
    Rule("URL", "URL_ADDRESS", r"https?://[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+", 0.80, guards=("://",)),
)


def pieces(pattern: str) -> list[tuple[str, bool]]:
    """The pattern's smallest parts, translated, and whether each is a capturing parenthesis."""
    out, inside = [], False
    for m in _PIECE.finditer(pattern):
        piece = m[0]
        if piece == r"[\s\S]" and not inside:
            out.append((r"(?s:.)", False))
            continue
        if piece == "[" and inside:
            piece = r"\["
        elif piece in "[]" and len(piece) == 1:
            inside = piece == "["
        if len(piece) == 2 and piece[0] == "\\":
            if piece[1] in "bB":
                raise PatternError(f"a word boundary within a pattern: {pattern}")
            if (held := _CLASSES.get(piece[1].lower())) is not None:
                negated = piece[1].isupper()
                if inside and negated:
                    raise PatternError(f"a negated class within a class: {pattern}")
                piece = held if inside else f"[{'^' * negated}{held}]"
        out.append((piece, piece == "(" and not inside))
    return out


def steady(core: str) -> tuple[str, str]:
    """What stands before a pattern, and the pattern: the same matches, in time proportional to the text.

    A run of a class at the beginning is looked for at its first character only, since the character that must end it is not of the
    class; spaces around a mark and between words are given back to nobody.
    """
    run = _RUN_FIRST.match(core) if "|" not in core else None
    edge = ""
    if run and not re.fullmatch(run[1], run[2]):
        edge = rf"(?:\G|(?<!{run[1]}))"
        core = f"{run[1]}++{core[run.end(1) + 1 :]}"
    core = _OPTIONAL.sub(r"\\s*+(?:\1\\s*+)?+", core)
    return edge, _WORDS.sub(r"\1\2++\\s++)", core)


def ending(rule: Rule) -> str | None:
    """What every match ends with, if anything may stand before it: nothing behind its last place needs a look."""
    flags = _FLAGS.match(rule.pattern)
    core = rule.pattern[flags.end() if flags else 0 :]
    _, gap, tail = core.rpartition(r"[\s\S]*?")
    if not gap or not tail or rule.group or tail.endswith(r"\b"):
        return None
    return f"(?s{flags[1] if flags else ''})\\A.*" + "".join("(?:" if opens else piece for piece, opens in pieces(tail))


def translate(rule: Rule) -> str:
    """The pattern for Spark: group 1 is what stands before the span, group 2 the span."""
    flags = "".join(m[1] for m in [_FLAGS.match(rule.pattern)] if m)
    core = rule.pattern[len(flags) + 3 :] if flags else rule.pattern
    left = core.startswith(r"\b")
    core = core[2:] if left else core
    right = bool(re.search(r"(?<!\\)(?:\\\\)*\\b$", core))
    core = core[:-2] if right else core
    edge, core = ("", steady(core)[1]) if left or rule.group else steady(core)
    parts = pieces(core)
    groups = [i for i, (_, opens) in enumerate(parts) if opens]
    if not 0 <= rule.group <= len(groups):
        raise PatternError(f"group {rule.group} of {rule.name} does not exist")
    spelt = ["(?:" if opens else piece for piece, opens in parts]
    if rule.group:
        at = groups[rule.group - 1]
        if _end_of(parts, at) != len(parts) - 1:
            raise PatternError(f"the group of {rule.name} does not end its pattern")
        before, value = "".join(spelt[:at]), "".join(spelt[at + 1 : -1])
    else:
        before, value = "", "".join(spelt)
    # What must come first is looked for first: that is cheaper than the boundary.
    first = _FIRST.match(core) if left and not rule.group and "|" not in core else None
    ahead = f"(?={''.join(piece for piece, _ in pieces(first[1]))}{'{' + first[2] + '}' if first[2] else ''})" if first else ""
    unicode_flags = f"(?{flags}{'u' if 'i' in flags else ''})" if flags else ""
    return f"{unicode_flags}{ahead}({_LEFT if left else edge}{before})({value}){_RIGHT if right else ''}"


def _end_of(parts: list[tuple[str, bool]], at: int) -> int:
    depth, inside = 0, False
    for i in range(at, len(parts)):
        piece = parts[i][0]
        if piece in ("[", "]"):
            inside = piece == "["
        elif not inside and piece != "(?s:.)":
            depth += piece.startswith("(")
            depth -= piece == ")"
            if depth == 0:
                return i
    return -1


def native(rule: Rule) -> bool:
    """Whether Spark's own functions can run the rule."""
    try:
        translate(rule)
    except PatternError as error:
        if "does not end" in str(error):
            return False
        raise
    return True


def merged(extra: tuple[Rule, ...] = (), base: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Base rules and further ones, by kind and then in order; of two equal patterns of a kind the first counts."""
    from palimpsest.functions.entities import TYPE_ID

    out: dict[tuple[str, str], Rule] = {}
    for rule in (*base, *extra):
        out.setdefault((rule.kind, rule.pattern), rule)
    return tuple(sorted(out.values(), key=lambda r: TYPE_ID[r.kind]))
