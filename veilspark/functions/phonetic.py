"""Double Metaphone keys of English words, after the published algorithm's main rules."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the algorithm: pattern at a place of the upper-case word (with what stands before it),
# primary code, secondary code. The first pattern that fits is used; a letter without one is silent.
_RULES = [(re.compile(p), a, b) for p, a, b in [
    (r"^(?:[GKP]N|WR|PS)", "", ""),  # silent first letters, handled by their second letter below
    (r"^X", "S", "S"), (r"^WH", "A", "A"), (r"^W(?=[AEIOUY])", "A", "F"), (r"^[AEIOUY]", "A", "A"), (r"[AEIOUY]+", "", ""),
    (r"(?<=M)B$", "", ""), (r"BB?", "P", "P"),
    (r"^CAESAR", "SSR", "SSR"), (r"CHIA", "K", "K"), (r"^CH(?=ARAC|ARIS|OR|YM|IA|EM)", "K", "K"), (r"(?<=S)CH(?=[EI])", "X", "SK"), (r"CH", "X", "K"),
    (r"CZ", "S", "X"), (r"CIA", "X", "X"), (r"CC(?=[IEH])(?!HU)", "KS", "X"), (r"C[KGQ]", "K", "K"), (r"C(?=[IEY])", "S", "S"), (r"CC?", "K", "K"),
    (r"DG(?=[IEY])", "J", "J"), (r"DG", "TK", "TK"), (r"D[TD]", "T", "T"), (r"D", "T", "T"), (r"FF?", "F", "F"),
    (r"(?<=[AEIOUY])GH(?=T|$)", "", ""), (r"^GH", "K", "K"), (r"(?<=[AOUE]U)GH", "F", "F"), (r"GH", "K", "K"),
    (r"GN(?=$|ED|S)", "N", "KN"), (r"GN", "KN", "N"), (r"GLI", "KL", "L"), (r"^G(?=Y|ES|EP|EB|EL|EY|IB|IL|IN|IE|EI|ER)", "K", "J"),
    (r"G(?=[EIY])", "J", "K"), (r"GG?", "K", "K"), (r"(?:^|(?<=[AEIOUY]))H(?=[AEIOUY])", "H", "H"), (r"H", "", ""),
    (r"^J", "J", "A"), (r"JJ?", "J", "J"), (r"KK?", "K", "K"), (r"LL?", "L", "L"), (r"MM?B?(?=$)", "M", "M"), (r"MM?", "M", "M"),
    (r"NN?", "N", "N"), (r"PH", "F", "F"), (r"P[PB]?", "P", "P"), (r"QQ?", "K", "K"), (r"RR?", "R", "R"),
    (r"(?<=[AEIOU])S(?=L[EY])", "", ""), (r"SH", "X", "X"), (r"S(?=I[OA])", "S", "X"), (r"SCH", "X", "SK"), (r"SC(?=[IEY])", "S", "S"), (r"SC", "SK", "SK"),
    (r"S[SZ]", "S", "S"), (r"S", "S", "S"), (r"TION", "XN", "XN"), (r"T(?:IA|CH)", "X", "X"), (r"TH", "0", "T"), (r"TT?", "T", "T"),
    (r"VV?", "F", "F"), (r"W(?=H|[AEIOUY])", "", ""), (r"W", "", ""), (r"XX?", "KS", "KS"), (r"ZH", "J", "J"), (r"ZZ?", "S", "TS"),
]]


@lru_cache(maxsize=100_000)
def double_metaphone(word: str) -> tuple[str, str]:
    """Primary and secondary key, four characters at most; both empty for a word without letters."""
    w = re.sub("[^A-Z]", "", word.upper())
    if re.match("GN|KN|PN|WR|PS", w):
        w = w[1:]
    first, second, at = "", "", 0
    while at < len(w) and (len(first) < 4 or len(second) < 4):
        for pattern, a, b in _RULES[1:]:
            if m := pattern.match(w, at):
                first, second, at = first + a, second + b, max(m.end(), at + 1)
                break
        else:
            at += 1
    return first[:4], second[:4]
