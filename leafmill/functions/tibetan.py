"""Syllables in Tibetan script: their parts, transliteration both ways by longest match, and forms for comparing.

A syllable is an onset (a stack of root, superscript and subscripts, perhaps after a prefix), a vowel and a coda (a suffix, a second
suffix, or an affix with a vowel of its own). Which parts go together follows from the rules below, so all onsets and codas are made
from them; a trie of each is walked for the longest match. What the rules do not know is read as loose stacks, as loans are written,
and what is no syllable at all is kept between brackets and reported.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame

# Letters, vowel signs, finals and marks with their Latin names.
LETTERS = dict(zip("k kh g ng c ch j ny t th d n p ph b m ts tsh dz w zh z ' y r l sh s h a".split(), "ཀཁགངཅཆཇཉཏཐདནཔཕབམཙཚཛཝཞཟའཡརལཤསཧཨ", strict=True))
LOAN_LETTERS = dict(zip("T Th D N Sh".split(), "ཊཋཌཎཥ", strict=True))
VOWELS = {"a": "", "i": "ི", "u": "ུ", "e": "ེ", "o": "ོ"}
LOAN_VOWELS = {"A": "ཱ", "I": "ཱི", "U": "ཱུ", "ai": "ཻ", "au": "ཽ", "-i": "ྀ"}
FINALS = {"M": "ཾ", "~M": "ྃ", "H": "ཿ"}
MARKS = {" ": "་", "*": "༌", "/": "།", "//": "༎", ";": "༏", "|": "༑", "!": "༈", ":": "༔", "_": " ", "@": "༄", "#": "༅", "(": "༼", ")": "༽", "<": "༺", ">": "༻", "\n": "\n", "\t": "\t"} | {str(i): chr(0xF20 + i) for i in range(10)}
# Which roots, with their super- and subscripts, go with each other part.
SUPERSCRIPTS = {"r": "k g ng j ny t d n b m ts dz", "l": "k g ng c j t d p b h", "s": "k g ng ny t d n p b m ts"}
SUBSCRIPTS = {"y": "k kh g p ph b m rk rg rm sk sg sp sb sm", "r": "k kh g t th d n p ph b m sh s h sk sg sn sp sb sm", "l": "k g b z r s", "w": "k kh g c ny t d ts tsh zh z r l sh s h gr phy rg rts"}
PREFIXES = {
    "g": "c ny t d n ts zh z y sh s",
    "d": "k g ng p b m ky gy py by my kr gr pr br",
    "b": "k g c t d ts zh z sh s ky gy kr gr sr kl zl rl sl rk rg rng rj rny rt rd rn rts rdz lt ld sk sg sng sny st sd sn sts rky rgy sky sgy skr sgr",
    "m": "kh g ng ch j ny th d n tsh dz khy gy khr gr",
    "'": "kh g ch j th d ph b tsh dz khy gy phy by khr gr dr phr br",
}
SUFFIXES = "g ng d n b m ' r l s".split()
SECOND_SUFFIXES = {"s": "g ng b m", "d": "n r l"}
AFFIXES = ["'i", "'is", "'o", "'u", "'am", "'ang"]
#: Of a syllable of three plain letters that can be read in two ways, whether the second letter is the root.
ROOT_SECOND = {"d": True, "'": True, "g": False, "b": False, "m": False}

SUBJOINED = 0x50


class Parts(NamedTuple):
    """The parts of a syllable by their Latin names; empty where there is none. prefix and superscript are silent, in the main."""

    prefix: str
    superscript: str
    root: str
    subscript: str
    vowel: str
    coda: str
    affix: str


def _stacked(names: Iterable[str]) -> str:
    first, *others = [(LETTERS | LOAN_LETTERS)[n] for n in names]
    return first + "".join(chr(ord(c) + SUBJOINED) for c in others)


@lru_cache(None)
def _stacks() -> dict[str, tuple[str, str, str]]:
    """Latin name of each stack -> (superscript, root, subscripts)."""
    out = {root: ("", root, "") for root in LETTERS}
    for over, roots in SUPERSCRIPTS.items():
        out |= {over + root: (over, root, "") for root in roots.split()}
    for under in "yrlw":
        out |= {name + under: (*out[name][:2], out[name][2] + under) for name in SUBSCRIPTS[under].split() if name in out}
    return out


def _names(superscript: str, root: str, subscript: str) -> list[str]:
    return [*filter(None, [superscript]), root, *subscript]


@lru_cache(None)
def onsets() -> dict[str, tuple[str, Parts]]:
    """Latin name -> (script, parts) of all onsets. A prefix before the root y has a point after it, as gy is a stack."""
    stacks = _stacks()
    out = {}
    for name, (over, root, under) in stacks.items():
        latin = "" if name == "a" else name
        out[latin] = (_stacked(_names(over, root, under)), Parts("", over, root, under, "", "", ""))
    for prefix, names in PREFIXES.items():
        for name in names.split():
            over, root, under = stacks[name]
            point = "." if prefix + name in stacks else ""
            out[prefix + point + name] = (LETTERS[prefix] + _stacked(_names(over, root, under)), Parts(prefix, over, root, under, "", "", ""))
    return out


@lru_cache(None)
def codas() -> dict[str, tuple[str, str, str]]:
    """Latin name -> (script, suffixes, affix) of all codas."""
    plain = ["", *SUFFIXES, *(first + second for second, firsts in SECOND_SUFFIXES.items() for first in firsts.split())]
    letters = lambda name: "".join(LETTERS[n] for n in ([name] if name in LETTERS else [name[:-1], name[-1]] if name else []))
    out = {name: (letters(name), name, "") for name in plain}
    for affix in AFFIXES:
        script = LETTERS["'"] + VOWELS[affix[1]] + "".join(LETTERS[n] for n in ([affix[2:]] if affix[2:] else []))
        out[affix] = (script, "", affix)
    return out


class Trie:
    """Strings with values, for the longest one that a text goes on with."""

    def __init__(self, items: dict[str, object]):
        self.root: dict = {}
        for key, value in items.items():
            node = self.root
            for c in key:
                node = node.setdefault(c, {})
            node[None] = value

    def matches(self, text: str, at: int) -> Iterator[tuple[int, object]]:
        """(end, value) of all strings that the text goes on with at a place, the longest first."""
        found, node = [], self.root
        while node is not None:
            if None in node:
                found.append((at, node[None]))
            node = node.get(text[at]) if at < len(text) else None
            at += 1
        return reversed(found)


class _Latin(NamedTuple):
    onsets: Trie
    vowels: Trie
    codas: Trie
    stacks: Trie
    loan_vowels: Trie
    finals: Trie
    marks: Trie


@lru_cache(None)
def _latin() -> _Latin:
    loose = {name: _stacked(_names(*p)) for name, p in _stacks().items() if name != "a"} | LOAN_LETTERS
    return _Latin(Trie({k: v for k, v in onsets().items()}), Trie(VOWELS), Trie(codas()), Trie(loose), Trie(VOWELS | LOAN_VOWELS), Trie(FINALS), Trie(MARKS))


def _is_mark(c: str) -> bool:
    return c in MARKS or c.isspace()


def latin_syllable(text: str) -> str | None:
    """Script of one Latin syllable; None if it is none."""
    t = _latin()
    for end, (onset, _) in t.onsets.matches(text, 0):
        for vowel_end, vowel in t.vowels.matches(text, end):
            for coda_end, (coda, _, _) in t.codas.matches(text, vowel_end):
                if coda_end == len(text):
                    return onset + vowel + coda
    return _loan(text)


def _loan(text: str) -> str | None:
    """Loose stacks, joined by +, each with a vowel and finals or none."""
    t, out, at, vowels = _latin(), [], 0, 0
    while at < len(text):
        stack, joined = "", True
        while joined and (found := next(t.stacks.matches(text, at), None)):
            at, letters = found
            stack += letters if not stack else "".join(chr(ord(c) + SUBJOINED) if ord(c) < 0xF90 else c for c in letters)
            joined = text[at : at + 1] == "+"
            at += joined
        if stack and joined:
            return None
        vowel = next(t.loan_vowels.matches(text, at), None)
        if not stack and not vowel:
            return None
        if vowel:
            at, sign = vowel
            vowels += 1
            stack = (stack or LETTERS["a"]) + sign
        while final := next(t.finals.matches(text, at), None):
            at, sign = final
            stack += sign
        out.append(stack)
    return "".join(out) if vowels else None


def to_script(text: str) -> tuple[str, list[tuple[int, int]]]:
    """Script of a Latin text, and the spans that are no syllables: these stand in brackets as they are."""
    out, faults, at = [], [], 0
    marks = _latin().marks
    while at < len(text):
        if text[at] == "[" and (close := text.find("]", at)) > 0:
            out.append(text[at : close + 1])
            at = close + 1
        elif _is_mark(text[at]):
            found = next(marks.matches(text, at), (at + 1, text[at]))
            out.append(found[1])
            at = found[0]
        else:
            end = next((i for i in range(at, len(text)) if _is_mark(text[i]) or text[i] == "["), len(text))
            end = max(end, at + 1)
            script = latin_syllable(text[at:end])
            if script is None:
                faults.append((at, end))
            out.append(f"[{text[at:end]}]" if script is None else script)
            at = end
    return "".join(out), faults


@lru_cache(None)
def _script() -> dict:
    """What the reading of script needs: names by character, onsets and codas by script."""
    letters = {v: k for k, v in (LETTERS | LOAN_LETTERS).items()}
    names = letters | {chr(ord(c) + SUBJOINED): "+" + n for c, n in letters.items()}
    signs = {v: k for k, v in (VOWELS | LOAN_VOWELS).items() if v}
    return {
        "names": names,
        "signs": Trie(signs),
        "sign_chars": {c for s in signs for c in s},
        "finals": {v: k for k, v in FINALS.items()},
        "marks": {v: k for k, v in MARKS.items()},
        "onsets": {script: (latin, parts) for latin, (script, parts) in onsets().items()},
        "codas": {script: (latin, suffix, affix) for latin, (script, suffix, affix) in codas().items()},
        "vowels": {v: k for k, v in VOWELS.items()},
    }


@lru_cache(100_000)
def readings(syllable: str) -> tuple[tuple[str, Parts], ...]:
    """(Latin name, parts) of the ways to read a syllable in script by the rules, the preferred one first; none for loans and others."""
    s, found = _script(), []
    for end in range(1, min(len(syllable), 5) + 1):
        onset = s["onsets"].get(syllable[:end])
        if not onset:
            continue
        latin, parts = onset
        for stop in (end + 1, end):
            vowel = s["vowels"].get(syllable[end:stop])
            coda = s["codas"].get(syllable[stop:])
            if vowel is None or coda is None or stop > len(syllable):
                continue
            # a bare root after a prefix is written with a suffix, else the prefix would be read as the root
            if vowel == "a" and parts.prefix and not parts.superscript and not parts.subscript and not coda[0]:
                continue
            found.append((latin + vowel + coda[0], parts._replace(vowel=vowel, coda=coda[1], affix=coda[2])))
    if len(found) > 1:
        # d as a second suffix is old, so a prefix is likelier
        second = ROOT_SECOND.get(s["names"][syllable[0]], False) or s["names"].get(syllable[-1]) == "d"
        found.sort(key=lambda f: bool(f[1].prefix) != second)
    return tuple(found)


def _loan_name(syllable: str) -> str | None:
    s, out, at = _script(), [], 0
    while at < len(syllable):
        name = s["names"].get(syllable[at])
        if name is None or name[0] == "+":
            return None
        at += 1
        while at < len(syllable) and s["names"].get(syllable[at], "")[:1] == "+":
            name += s["names"][syllable[at]]
            at += 1
        sign = next(s["signs"].matches(syllable, at), None)
        vowel = "a"
        if sign:
            at, vowel = sign
        name = ("" if name == "a" else name) + vowel
        while at < len(syllable) and syllable[at] in s["finals"]:
            name += s["finals"][syllable[at]]
            at += 1
        out.append(name)
    return "".join(out) or None


def to_latin(text: str) -> tuple[str, list[tuple[int, int]]]:
    """Latin names of a text in script, and the spans that cannot be read: these stand in brackets. What stands in brackets already is kept."""
    s, out, faults, at = _script(), [], [], 0
    inside = lambda c: c in s["names"] or c in s["sign_chars"] or c in s["finals"]
    while at < len(text):
        if text[at] == "[" and (close := text.find("]", at)) > 0:
            out.append(text[at : close + 1])
            at = close + 1
        elif inside(text[at]):
            end = next((i for i in range(at, len(text)) if not inside(text[i])), len(text))
            read = readings(text[at:end])
            name = read[0][0] if read else _loan_name(text[at:end])
            if name is None:
                faults.append((at, end))
            out.append(f"[{text[at:end]}]" if name is None else name)
            at = end
        elif text[at] in s["marks"]:
            out.append(s["marks"][text[at]])
            at += 1
        else:
            end = next((i for i in range(at + 1, len(text)) if inside(text[i]) or text[i] in s["marks"] or text[i] == "["), len(text))
            faults.append((at, end))
            out.append(f"[{text[at:end]}]")
            at = end
    return "".join(out), faults


# Letters of loans and variant signs as the plain ones that are read alike.
LENIENT = str.maketrans({"ཊ": "ཏ", "ཋ": "ཐ", "ཌ": "ད", "ཎ": "ན", "ཥ": "ཤ", "ྚ": "ྟ", "ྛ": "ྠ", "ྜ": "ྡ", "ྞ": "ྣ", "ྵ": "ྴ", "ཱ": None, "ཻ": "ེ", "ཽ": "ོ", "ྀ": "ི", "ྃ": "ཾ", "༌": "་", "ཪ": "ར", "ྺ": "ྭ", "ྻ": "ྱ", "ྼ": "ྲ"})
#: The syllables pa, po and their kind, which are written with b after some finals.
PABA = {"བ": "པ", "བོ": "པོ", "བར": "པར", "བས": "པས", "བའ": "པའ"}


def without_affix(syllable: str) -> str:
    """A syllable without its affix with a vowel. The silent suffix of a bare syllable comes back only where it must be written."""
    read = readings(syllable)
    if not read or not read[0][1].affix:
        return syllable
    parts = read[0][1]
    onset = syllable[: -len(codas()[parts.affix][0])]
    return onset + LETTERS["'"] if parts.prefix and parts.vowel == "a" and not parts.superscript and not parts.subscript else onset


def lenient(syllable: str) -> str:
    """The form of a syllable in which spellings that are read alike are equal: plain letters, no affix, p for b in pa and po."""
    bare = without_affix(syllable.translate(LENIENT))
    return PABA.get(bare, bare)


# Sounds of roots (plain; after a prefix or under a superscript), of roots with subscripts, and of codas.
_SOFT = {"g": ("kh", "g"), "j": ("ch", "j"), "d": ("th", "d"), "b": ("ph", "b"), "dz": ("tsh", "dz"), "zh": ("sh", "sh"), "z": ("s", "s")}
_CODA = {"g": "k", "gs": "k", "ng": "ng", "ngs": "ng", "d": "", "n": "n", "nd": "n", "b": "p", "bs": "p", "m": "m", "ms": "m", "'": "", "r": "r", "rd": "r", "l": "l", "ld": "l", "s": "", "": ""}
_FRONT = {"a": "e", "o": "ö", "u": "ü"}
_RETROFLEX = {"k": "tr", "t": "tr", "p": "tr", "kh": "thr", "th": "thr", "ph": "thr", "g": "dr", "d": "dr", "b": "dr"}
_PALATAL = {"p": "c", "ph": "ch", "b": "j", "m": "ny", "k": "ky", "kh": "khy", "g": "gy"}


def phonetic(syllable: str) -> str:
    """How a syllable sounds, roughly as in the central dialects: silent letters fall, subscripts change the root, and d, n, l, s at the
    end bring the vowel forward. Syllables outside the rules stay as their lenient form."""
    syllable = syllable.translate(LENIENT)
    read = readings(syllable)
    if not read:
        return lenient(syllable)
    p = read[0][1]
    led = bool(p.prefix or p.superscript)
    root, under = p.root, p.subscript.replace("w", "")
    if p.prefix == "d" and root == "b":
        sound = {"y": "y", "r": "r"}.get(under, "w" if p.vowel == "a" else "")
    elif p.superscript == "l" and root == "h":
        sound = "lh"
    elif under == "l":
        sound = "d" if root == "z" else "l"
    elif under == "r":
        sound = _RETROFLEX.get(root, "s" if root in ("s", "sh") else "hr" if root == "h" else root)
        sound = {"dr": "thr"}.get(sound, sound) if not led else sound
    elif under == "y":
        sound = _PALATAL.get(root, root)
        sound = {"gy": "khy", "j": "ch"}.get(sound, sound) if not led else sound
    elif root in _SOFT:
        sound = _SOFT[root][led]
    else:
        sound = {"'": "", "a": ""}.get(root, root)
    vowel = _FRONT.get(p.vowel, p.vowel) if p.coda in ("d", "n", "nd", "l", "ld", "s") else p.vowel
    return sound + vowel + _CODA.get(p.coda, p.coda)


def transliterated(df: DataFrame, column: str, to: str = "script") -> DataFrame:
    """df with <column>_<to> (script or latin; null for null) and <column>_faults, the spans of the text that could not be read. The text
    is read batch by batch; the tables are made from the rules in each worker, so nothing is sent along."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    f = {"script": to_script, "latin": to_latin}[to]
    span = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())])
    schema = StructType([StructField("out", StringType()), StructField("faults", ArrayType(span))])

    @F.arrow_udf(schema)
    def read(texts):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        rows = [(None, None) if t is None else f(t) for t in texts.to_pylist()]
        faults = [None if b is None else [{"begin": x, "end": y} for x, y in b] for _, b in rows]
        return pa.StructArray.from_arrays([pa.array([a for a, _ in rows], pa.string()), pa.array(faults, to_arrow_type(ArrayType(span)))], names=["out", "faults"])

    return df.withColumn("_read", read(F.col(column))).withColumns({f"{column}_{to}": F.col("_read")["out"], f"{column}_faults": F.col("_read")["faults"]}).drop("_read")
