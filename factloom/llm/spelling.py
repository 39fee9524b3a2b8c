"""Reading names as people type them: folding, word forms, abbreviations, nicknames (part of problem 1)."""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

import numpy as np

# Given names, each with its short, pet and foreign forms.
GIVEN = """
alexander alex al alec sandy sasha aleksandr alexandre alejandro xander
antonia toni tonia tonya antonina antoinette
barbara barb babs barbie bobbie
benjamin ben benny benji
catherine cathy cath kate katie kathy katherine kathryn catharine kitty katharina
christopher chris kit kristopher topher christoph
daniel dan danny daniil
dorothy dot dottie dolly dorothea dora
edward ed eddie ted teddy ned eduard
elizabeth liz beth betty lizzie eliza elisabeth elsie libby bess
frances fran frankie francie fanny francesca
frederick fred freddie freddy fritz frederic friedrich fredrick
gabriella gabby gabi gabriela gabrielle ella
gregory greg gregor grigory gregg
helena helen lena helene ellen elena nell
henry hank harry hal henri heinrich
ignatius iggy ignacio nacho ignaz
isabella bella isabel izzy isabelle isobel
james jim jimmy jamie jem
josephine josie jo josefine josephina josefina
kimberly kim kimberley kimmy
konstantin kostya constantine constantin konstantine
lawrence larry laurence lars lorenz laurie
leonard leo lenny len leonhard
margaret maggie peggy meg marge margie margarita margarethe
michael mike mick mickey mikhail misha michel miguel
natalia natasha natalie nathalie nat nataliya
nicholas nick nicky nikolas nicolas nikolai niko
patricia pat patty trish tricia patrizia
philip phil phillip pip philippe
rebecca becky becca rebekah reba
robert bob bobby rob robbie roberto bert
samuel sam sammy
susan sue susie suzy suzanne susanna susanne
theresa terry teresa tess tessa therese tracy
thomas tom tommy tomas thom
victoria vicky vicki viktoria tori vic
vincent vince vinnie vinny vincenzo
walter walt wally walther
william bill billy will willie liam wilhelm
andrew andy drew andrei andreas
anthony tony antonio anton
charles charlie chuck karl carlos
david dave davy
george jorge georg georgy
john jack johnny jon johann juan ivan
joseph joe joey jose josef
maria mary marie mariya molly
patrick pat paddy
peter pete pyotr pedro pierre
richard rick dick rich ricky
stephen steve stefan steven stepan
"""
# Titles before names.
TITLES = set("dr prof professor hon minister amb ambassador gen general col colonel mr mrs ms miss sir dame lord lady lt maj major capt captain sgt sen senator rep president pres judge rev rt the".split())
# Words of organisations, places and events, each with its abbreviations and other spellings.
WORDS = {
    "ORG": """
research res
centre center ctr cntr
company co coy
association assn assoc
corporation corp
statistics stat stats statistical
agricultural agri agric agriculture
security sec
department dept dep dpt
energy
maritime mar
border bdr
shipping shpg ship
limited ltd
grain gr
telecommunications telecom telecoms tel telco telecomm
commission comm commn
environmental env environ environment
foundation fdn found
international intl int
defence def defense
institute inst instit
ministry min
authority auth
agency agcy
bureau bur
council cncl
committee cttee cmte
union un
university univ uni
bank bk
group grp
holdings hldgs
national natl nat
federal fed
transport transp
health hlth
finance fin
industry ind
""",
    "GPE": """
island isl is isle
province prov prv
strait str strt
south s sth
north n nth
east e
west w
mount mt mnt
port pt prt
lowlands lowland
highlands highl
district dist
county cty
river riv
lake lk
bay
cape
saint st
city
""",
    "EVENT": """
summit smt
conference conf
operation op oper opn
exercise ex exer
forum
congress congr
campaign camp
meeting mtg
""",
}
SMALL = {"the", "of", "and", "for", "de", "la"}
_TOKEN = re.compile(r"'\d\d\b|[^\W_]+")


def table(lines: str) -> dict[str, frozenset[str]]:
    """form -> the first words of all lines it stands in."""
    out: dict[str, frozenset[str]] = {}
    for line in lines.strip().splitlines():
        head, *rest = line.split()
        for form in (head, *rest):
            out[form] = out.get(form, frozenset()) | {head}
    return out


_GIVEN = table(GIVEN)
_WORDS = {kind: {form: min(heads) for form, heads in table(lines).items()} for kind, lines in WORDS.items()}
#: First letters under which a given name is shortened to an initial: those of its full forms in any language.
_FULL_LENGTH = 6


def fold(name: str) -> str:
    """Lower case without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", name).casefold()) if not unicodedata.combining(c)).replace("’", "'")


def damerau(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, size: int) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distance, a true metric, of each row pair of two padded code arrays.

    Codes are below `size`; padding may be anything below it, since results are read at the rows' lengths."""
    n, rows = len(a), np.arange(len(a))
    d = np.zeros((n, a.shape[1] + 2, b.shape[1] + 2), np.int16)
    far = (la + lb).astype(np.int16)
    d[:, 0, :], d[:, :, 0] = far[:, None], far[:, None]
    d[:, 1, 1:], d[:, 1:, 1] = np.arange(b.shape[1] + 1), np.arange(a.shape[1] + 1)
    last_row = np.zeros((n, size), np.int16)
    for i in range(1, a.shape[1] + 1):
        last_column = np.zeros(n, np.int16)
        for j in range(1, b.shape[1] + 1):
            k, at = last_row[rows, b[:, j - 1]], last_column
            same = a[:, i - 1] == b[:, j - 1]
            swap = d[rows, k, at] + (i - k - 1) + 1 + (j - at - 1)
            d[:, i + 1, j + 1] = np.minimum(np.minimum(d[:, i, j] + ~same, swap), np.minimum(d[:, i + 1, j], d[:, i, j + 1]) + 1)
            last_column = np.where(same, j, last_column).astype(np.int16)
        last_row[rows, a[:, i - 1]] = i
    return d[rows, la + 1, lb + 1]


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as padded arrays of code points, and their lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), int(lengths.max(initial=0))), np.int64)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(c) for c in w]
    return out, lengths


#: Cells of the distance tables that are held at once.
CELLS = 4_000_000


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """Distances of the word pairs left[i], right[i], in parts of like length."""
    n = len(left)
    size = np.array([max(len(a), len(b)) for a, b in zip(left, right, strict=True)], np.int64)
    out, order, at = np.zeros(n, np.int64), np.argsort(size, kind="stable"), 0
    while at < n:
        end = at + 1
        while end < n and (end - at + 1) * (size[order[end]] + 2) ** 2 <= CELLS:
            end += max(1, min(n - end - 1, (end - at) // 2))
        end = min(end, n)
        rows = order[at:end]
        codes, lengths = encode([*[left[i] for i in rows], *[right[i] for i in rows]])
        alphabet, compact = np.unique(codes, return_inverse=True)
        compact, m = compact.reshape(codes.shape), len(rows)
        out[rows] = damerau(compact[:m], lengths[:m], compact[m:], lengths[m:], len(alphabet))
        at = end
    return out


_near: dict[tuple[str, str], frozenset[str]] = {}


def is_contraction(short: str, word: str) -> bool:
    """Whether `short` keeps the first letter of `word` and some later ones in their order."""
    rest = iter(word[1:])
    return 2 <= len(short) < len(word) and short[0] == word[0] and all(c in rest for c in short[1:])


@functools.lru_cache(maxsize=10_000)
def _bits(word: str) -> int:
    return functools.reduce(lambda bits, c: bits | 1 << ord(c) % 64, word, 0)


def listed(word: str, kind: str) -> frozenset[str]:
    """The words of the kind's list that an unlisted word can stand for: its one-edit misspellings of long forms, else
    the contractions of a first form (three letters or more)."""
    key = (kind, word)
    if key not in _near:
        if len(_near) > 200_000:
            _near.clear()
        forms = _WORDS[kind]
        own = _bits(word)  # one edit changes two letters at most
        near = [f for f in forms if len(f) >= 5 and abs(len(f) - len(word)) <= 1 and (_bits(f) ^ own).bit_count() <= 2] if len(word) >= 4 else []
        hits = {forms[f] for f, d in zip(near, distances([word] * len(near), near), strict=True) if d <= 1} if near else set()
        if not hits and len(word) >= 3:
            hits = {h for h in set(forms.values()) if len(h) >= 5 and is_contraction(word, h)}
        _near[key] = frozenset(hits)
    return _near[key]


@dataclass(frozen=True)
class Name:
    """A name as it is read. kind: what two names must share besides words (type, year of an event). initial: the letter
    that stands for a given name, or empty. words: (word as typed, what it can mean), in order of the words; short: those
    of them that are written as abbreviations no list knows (with a full stop, or without a vowel)."""

    kind: str
    initial: str
    words: tuple[tuple[str, tuple[str, ...]], ...]
    short: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return "\x1f".join([self.kind, self.initial, *("/".join(m) for _, m in self.words), *(f"{w}." for w in self.short)])


def parse(kind: str | None, name: str) -> Name:
    """The words of a name without order, titles, small words and additions in brackets.

    A word of a list means the first words of its lines, any other means itself; lists only make words equal, nothing is
    kept apart by them. Misspelt or contracted words of organisations, places and events mean the listed word as well."""
    folded = fold(name)
    return _person(folded) if kind == "PERSON" else _thing(str(kind), folded)


def _last(word: str) -> str:
    """The last letter that a contraction keeps: the last consonant."""
    return next((c for c in reversed(word) if c not in _VOWELS), word[-1])


def _sorted(words: list[tuple[str, tuple[str, ...]]]) -> tuple:
    return tuple(sorted(words, key=lambda w: (w[1], w[0])))


def _thing(kind: str, folded: str) -> Name:
    known = _WORDS.get(kind, {})
    for written, word in (("int'l", "intl"), ("dep't", "dept"), ("nat'l", "natl"), ("ass'n", "assn")):
        folded = folded.replace(written, word)
    bare = re.sub(r"\((?!\s*'?\d)[^()]*\)", " ", folded)
    bare = bare if _TOKEN.search(bare) else folded
    words, short, year = [], [], ""
    for m in _TOKEN.finditer(bare):
        w = m.group()
        if kind == "EVENT" and re.fullmatch(r"'\d\d|(?:19|20)\d\d", w):
            year = "20" + w[1:] if w[0] == "'" else w
        elif w in known:
            words.append((w, (known[w],)))
        elif w in SMALL:
            continue
        else:
            hits = listed(w, kind) if known else frozenset()
            clipped = known and 2 <= len(w) <= 6 and w.isalpha() and (bare[m.end() : m.end() + 1] == "." or not set(w) & _VOWELS)
            if hits and not (clipped and not all(w[-1] == _last(h) for h in hits)):
                words.append((w, tuple(sorted(hits))))
            elif clipped:
                short.append(w)
            else:
                words.append((w, (w,)))
    return Name(f"{kind}|{year}", "", _sorted(words), tuple(sorted(short)))


def _person(folded: str) -> Name:
    bare = re.sub(r"\([^()]*\)", " ", folded)
    halves = [[w for w in _TOKEN.findall(h) if w not in TITLES] for h in (bare if _TOKEN.search(bare) else folded).split(",", 1)]
    words = [w for h in halves for w in h]
    full = [w for w in words if len(w) > 1]
    single = [w for w in words if len(w) == 1]
    first = len(halves) == 2 and halves[0] and halves[1] and len(halves[1][0]) == 1  # "Surname, I."
    lead = len(halves) < 2 and words and len(words[0]) == 1
    initial = ""
    if full and single and (len(full) == 1 or first or lead):
        initial = halves[1][0] if first else single[0]
    own = full or words or [folded.strip()]
    return Name("PERSON|", initial, _sorted([(w, tuple(sorted(_GIVEN.get(w, (w,))))) for w in own]))


def initials(word: str) -> frozenset[str]:
    """Letters that can stand for a given name: of the word itself, of its full forms, and of like foreign forms."""
    return frozenset({word[0], *(g[0] for g in _GIVEN.get(word, ())), *(c for g in _GIVEN.get(word, ()) for c in _LETTERS.get(g, ()))})


def _letters() -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for form, heads in _GIVEN.items():
        for g in heads:
            if len(form) >= _FULL_LENGTH and form[0] != g[0] and distances([form[1:]], [g[1:]])[0] <= 1:
                out.setdefault(g, set()).add(form[0])
    return out


_VOWELS = set("aeiouyаеиоуыэюя")
_LETTERS = _letters()
#: Given names of five letters or more, as the words that a misspelling is compared with.
LONG_GIVEN = {form: tuple(sorted(heads)) for form, heads in _GIVEN.items() if len(form) >= 5}
