"""Configuration of a vector store and of the sentence lexer."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

#: Parameters of the commands, for listing.
PARAMETERS = {
    "create": {"vecdim": "dimension of vectors", "bits": "bits of a variation", "variations": "number of rotations", "lextypes": "types of the lexer by priority", "coversim": "cosine above which features group together", "recall": "recall factor of the lexer's searches", "spacesb": "character for a space", "linksb": "character for a link"},
    "open": {"memtypes": "types held in memory", "lextypes": "types of the lexer by priority", "coversim": "cosine above which features group together", "recall": "recall factor of the lexer's searches", "spacesb": "character for a space", "linksb": "character for a link"},
}
_FIXED = ("vecdim", "bits", "variations")


class ConfigError(ValueError):
    pass


def derived_bits(vecdim: int) -> int:
    """64, halved until it is at most half the dimension."""
    bits = 64
    while bits > 1 and bits > vecdim / 2:
        bits //= 2
    return bits


def derived_variations(vecdim: int, bits: int) -> int:
    return max(1, vecdim * 640 // (93 * bits))


def filter_benches(words: int) -> int:
    """Words used for filtering: at most four and at most a quarter of all, at least one."""
    return max(1, min(4, words // 4))


def parse_pairs(text: str) -> dict[str, str]:
    """``key=value`` pairs divided by semicolons; keys in lower case, values without outer spaces or quotes."""
    out = {}
    for part in filter(None, (p.strip() for p in (text or "").split(";"))):
        key, eq, value = part.partition("=")
        if not eq or not re.fullmatch(r"\s*[A-Za-z_]\w*\s*", key):
            raise ConfigError(f"not a key=value pair: {part!r}")
        out[key.strip().lower()] = value.strip().strip("'\"")
    return out


def parse_lextypes(text: str) -> dict[str, int]:
    """Priorities of types: ``,`` keeps the priority, ``:`` or ``/`` goes on to the next (L2)."""
    out: dict[str, int] = {}
    level, pos, want = 0, 0, True
    for m in re.finditer(r"\s*(?:([A-Za-z0-9_-]+)|([,:/])|(\S))", text or ""):
        if m[3] or (m[1] and not want) or (m[2] and want):
            raise ConfigError(f"unexpected {m[0].strip()!r} in the list of types")
        if m[1]:
            out.setdefault(m[1], level)
            want = False
        else:
            level += m[2] != ","
            want = True
        pos = m.end()
    if out and want:
        raise ConfigError("the list of types ends in a separator")
    return out


def _one_char(value: str, key: str) -> str:
    if len(value) != 1:
        raise ConfigError(f"{key} must be one character")
    return value


@dataclass(frozen=True)
class LexerConfig:
    lextypes: dict[str, int] = field(default_factory=dict)
    coversim: float = 0.8
    recall: float = 0.8
    spacesb: str = "_"
    linksb: str = "-"


@dataclass(frozen=True)
class StoreConfig:
    vecdim: int = 300
    bits: int = 64
    variations: int = 32
    memtypes: tuple[str, ...] = ()
    lexer: LexerConfig = field(default_factory=LexerConfig)
    #: given parameters that opening a store ignores
    ignored: tuple[str, ...] = ()

    @property
    def total_bits(self) -> int:
        return self.bits * self.variations

    @property
    def words(self) -> int:
        return -(-self.total_bits // 64)

    def text(self) -> str:
        """The configuration as a string that parses back to it."""
        levels: dict[int, list[str]] = {}
        for name, level in self.lexer.lextypes.items():
            levels.setdefault(level, []).append(name)
        lex = ":".join(",".join(levels[k]) for k in sorted(levels))
        parts = {"vecdim": self.vecdim, "bits": self.bits, "variations": self.variations, "lextypes": lex, "coversim": self.lexer.coversim, "recall": self.lexer.recall, "spacesb": self.lexer.spacesb, "linksb": self.lexer.linksb}
        return ";".join(f"{k}={v}" for k, v in parts.items() if v != "")


def _lexer(pairs: dict[str, str], base: LexerConfig) -> LexerConfig:
    return replace(
        base,
        lextypes=parse_lextypes(pairs["lextypes"]) if "lextypes" in pairs else base.lextypes,
        coversim=float(pairs.get("coversim", base.coversim)),
        recall=float(pairs.get("recall", base.recall)),
        spacesb=_one_char(pairs.get("spacesb", base.spacesb), "spacesb"),
        linksb=_one_char(pairs.get("linksb", base.linksb), "linksb"),
    )


def create_config(text: str) -> StoreConfig:
    """Configuration for creating a store; a given dimension derives bits and variations that aren't given."""
    pairs = parse_pairs(text)
    known = set(PARAMETERS["create"]) | {"lexprun", "memtypes"}
    if unknown := set(pairs) - known:
        raise ConfigError(f"unknown parameters: {sorted(unknown)}")
    base = StoreConfig()
    dim = int(pairs.get("vecdim", base.vecdim))
    bits = int(pairs["bits"]) if "bits" in pairs else derived_bits(dim) if "vecdim" in pairs else base.bits
    variations = int(pairs["variations"]) if "variations" in pairs else derived_variations(dim, bits) if {"vecdim", "bits"} & set(pairs) else base.variations
    if dim < 1 or bits < 1 or variations < 1:
        raise ConfigError("vecdim, bits and variations must be positive")
    return StoreConfig(dim, bits, variations, (), _lexer(pairs, base.lexer))


def open_config(stored: StoreConfig, text: str) -> StoreConfig:
    """The stored configuration with what the open string overrides; the model's parameters stay as they are."""
    pairs = parse_pairs(text)
    ignored = tuple(k for k in _FIXED if k in pairs)
    memtypes = tuple(filter(None, (t.strip() for t in pairs.get("memtypes", "").split(","))))
    return replace(stored, memtypes=memtypes, lexer=_lexer(pairs, stored.lexer), ignored=ignored)
