"""Options of the three queries and their text grammar."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field

log = logging.getLogger("strandframe")

#: Contexts of codes that are requested without one. All other codes have CG.
DEFAULT_CONTEXTS = {"m": "CG", "h": "CG", "f": "C", "c": "C", "C": "C", "g": "T", "e": "T", "b": "T", "T": "T", "U": "T", "a": "A", "A": "A", "o": "G", "G": "G", "n": "N", "N": "N", "*": "*"}
DEFAULT_THRESHOLD = 0.8
#: Code and context pairs whose results have been compared with another tool's.
TRIED = {("m", "CG"), ("h", "CG"), ("m", "C"), ("h", "C"), ("a", "A"), ("m", "*"), ("h", "*"), ("a", "*"), ("*", "*")}
_SPEC = re.compile(r"(?P<code>[A-Za-z*]+|[0-9]+)?(?:\[(?P<context>[^\]]*)\])?,?")


@dataclass(frozen=True)
class ModCode:
    """A requested code; ``threshold`` classifies its calls in ``freq``."""

    code: str
    context: str
    threshold: float = DEFAULT_THRESHOLD

    @property
    def reverse_context(self) -> str:
        return self.context[::-1].translate(str.maketrans("ACGTUN", "TGCAAN"))


def parse_codes(text: str = "m") -> list[ModCode]:
    """``code[context]``, comma separated: codes of letters and ``*``, or of digits; contexts of ACGTUN or ``*``."""
    out: list[ModCode] = []
    at = 0
    while at < len(text):
        found = _SPEC.match(text, at)
        if found is None or found.end() == at:
            raise ValueError(f"invalid character in modification codes at {at}: {text!r}")
        code, context = found["code"] or "", found["context"]
        after = text[found.end() :]
        if after and not text[: found.end()].endswith((",", "]")):
            raise ValueError(f"mixed or invalid modification code at {at}: {text!r}")
        if context is None:
            context = DEFAULT_CONTEXTS.get(code, "CG")
        elif context != "*":
            context = context.upper().replace("U", "T")
            if not context or re.search("[^ACGTN]", context):
                raise ValueError(f"invalid context of {code!r}: {text!r}")
        if any(x.code == code for x in out):
            raise ValueError(f"modification code {code!r} is given twice")
        out.append(ModCode(code, context))
        at = found.end()
    if not out:
        raise ValueError("no modification code")
    return out


def with_thresholds(codes: list[ModCode], text: str | None = None) -> list[ModCode]:
    """Thresholds from 0 to 1: one for all codes, or one for each in their order."""
    if text is None:
        return codes
    values = [float(x) for x in text.rstrip(",").split(",")]
    if any(not 0 <= v <= 1 for v in values):
        raise ValueError(f"thresholds must lie between 0 and 1: {text!r}")
    if len(values) == 1:
        values *= len(codes)
    if len(values) != len(codes):
        raise ValueError(f"{len(values)} thresholds for {len(codes)} codes")
    return [ModCode(c.code, c.context, v) for c, v in zip(codes, values, strict=True)]


def warn_untried(codes: list[ModCode]) -> list[str]:
    """Logs and returns the codes whose combination with their context nobody has compared with another tool."""
    out = [f"{c.code}[{c.context}]" for c in codes if (c.code, c.context) not in TRIED]
    for x in out:
        log.warning("%s has not been compared with another tool", x)
    return out


def parse_size(text: str) -> int:
    """``20M`` and the like, with decimal factors."""
    found = re.fullmatch(r"([0-9.]+)([KMGkmg]?)", text)
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(float(found[1]) * {"": 1, "k": 10**3, "m": 10**6, "g": 10**9}[found[2].lower()] + 0.499)


@dataclass(frozen=True)
class QueryOptions:
    codes: tuple[ModCode, ...] = field(default_factory=lambda: tuple(parse_codes()))
    insertions: bool = False
    haplotypes: bool = False
    allow_secondary: bool = False
    skip_supplementary: bool = False
    #: Look up each letter of a code of several, not the rest of the code from it.
    split_codes: bool = False
    batch_reads: int = 512
    batch_bytes: int = 20_000_000
    threads: int = 8

    def __post_init__(self) -> None:
        if self.batch_reads < 1 or self.threads < 1 or self.batch_bytes <= 0:
            raise ValueError("batch size, bytes and threads must be positive")

    @property
    def wildcard(self) -> ModCode | None:
        return next((c for c in self.codes if c.code == "*"), None)

    def sought(self) -> dict[str, ModCode]:
        """By code; a wildcard stands for all others."""
        return {"*": self.wildcard} if self.wildcard else {c.code: c for c in self.codes}
