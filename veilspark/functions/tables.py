"""Fixed values of public codes, alphabets and keyboards that the rules are built from."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

ALPHABET = "abcdefghijklmnopqrstuvwxyz"

# International Morse code, a to z.
MORSE = [
    ".-", "-...", "-.-.", "-..", ".", "..-.", "--.", "....", "..", ".---", "-.-", ".-..", "--",
    "-.", "---", ".--.", "--.-", ".-.", "...", "-", "..-", "...-", ".--", "-..-", "-.--", "--..",
]
# The digit of each letter on a telephone keypad (ITU E.161), a to z.
KEYPAD = "22233344455566677778889999"
# Letter rows of a QWERTY keyboard.
KEY_ROWS = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]
# Inflections of an answer that count as the answer; of answers in e and in y without that letter.
SUFFIXES = "s es ed d ing er ers ly y ier iest est ish ness ful less en ens ened ening ment ments".split()
SUFFIXES_E = "ing ed er ers".split()
SUFFIXES_Y = "ies ied ier iest".split()
# Letters that a digit or symbol stands for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
    "$": "s", "!": "i", "|": "l", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c",
}
# Pairs of letters that look like one, in the order of their replacement.
LOOKALIKES = [("vv", "w"), ("rn", "m"), ("cl", "d"), ("lj", "y"), ("nn", "m")]
# NATO spelling alphabet with its spelling variants.
NATO = {
    "alfa": "a", "alpha": "a", "bravo": "b", "charlie": "c", "delta": "d", "echo": "e", "foxtrot": "f", "golf": "g", "hotel": "h", "india": "i",
    "juliet": "j", "juliett": "j", "kilo": "k", "lima": "l", "mike": "m", "november": "n", "oscar": "o", "papa": "p", "quebec": "q", "romeo": "r",
    "sierra": "s", "tango": "t", "uniform": "u", "victor": "v", "whiskey": "w", "whisky": "w", "xray": "x", "yankee": "y", "zulu": "z",
}
# Names of letters in English, Spanish and German, and words that sound like them.
LETTER_NAMES = {
    "a": "a", "ay": "a", "aye": "a", "ah": "a", "bee": "b", "be": "b", "beh": "b", "cee": "c", "see": "c", "ce": "c", "sea": "c", "tseh": "c",
    "dee": "d", "de": "d", "deh": "d", "e": "e", "ee": "e", "eh": "e", "eff": "f", "ef": "f", "efe": "f", "gee": "g", "ge": "g", "geh": "g",
    "aitch": "h", "haitch": "h", "aych": "h", "hache": "h", "hah": "h", "eye": "i", "i": "i", "ih": "i", "jay": "j", "jota": "j", "yot": "j",
    "kay": "k", "ka": "k", "kah": "k", "el": "l", "ell": "l", "ele": "l", "em": "m", "eme": "m", "emm": "m", "en": "n", "ene": "n", "enn": "n",
    "oh": "o", "o": "o", "owe": "o", "pee": "p", "pe": "p", "pea": "p", "peh": "p", "cue": "q", "queue": "q", "cu": "q", "kuh": "q", "ar": "r",
    "are": "r", "arr": "r", "erre": "r", "err": "r", "ess": "s", "es": "s", "ese": "s", "tee": "t", "tea": "t", "te": "t", "teh": "t", "you": "u",
    "u": "u", "yu": "u", "yoo": "u", "ewe": "u", "yew": "u", "uh": "u", "vee": "v", "uve": "v", "fau": "v", "doubleu": "w", "doubleyou": "w",
    "dubya": "w", "dubs": "w", "dub": "w", "veh": "w", "weh": "w", "ex": "x", "eks": "x", "equis": "x", "iks": "x", "why": "y", "wye": "y",
    "ypsilon": "y", "zee": "z", "zed": "z", "zeta": "z", "tsett": "z",
}
# Number words.
UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
# Ordinals that are more than a number word and "th".
ORDINAL_UNITS = {"first": 1, "second": 2, "third": 3, "fifth": 5, "eighth": 8, "ninth": 9, "twelfth": 12}
ORDINAL_TENS = {"twentieth": 20, "thirtieth": 30}
# Characters without a glyph that hide inside words (a character class).
INVISIBLE = "[\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\u00ad\u034f\u061c\u180e\u115f\u1160\u3164\uffa0\u2800]"
# Letters drawn with slashes and bars, in the order of their replacement.
ASCII_ART = [("\\\\/\\\\/", "w"), ("\\\\/", "v"), ("\\|-\\|", "h"), ("\\|\\\\\\|", "n"), ("\\|/\\|", "m")]
# Chat markup, as pattern and replacement ($1 is the first group), in order.
MARKUP = [
    ("(?i):(?:regional_indicator_|letter_?)([a-z]):", " $1 "),
    ("(?i)<a?:(?:(?:[a-z0-9]+_)*([a-z])(?:_[a-z0-9]+)*|letter_?([a-z])):[0-9]+>", " $1$2 "),
    ("<a?:(\\w+):[0-9]+>", " $1 "),
    ("<(?:@!?|#|@&)[0-9]+>", " "),
    ("<t:[0-9]+(?::\\w)?>", " "),
    ("\\[([^\\]]*)\\]\\(([^)]*)\\)", " $1 $2 "),
    ("```", " "),
    ("\\*\\*|__|~~|\\|\\||`", ""),
    ("(?m)^(?:#{1,3}|-#)\\s", ""),
    ("(?m)^>{1,3}\\s?", ""),
    ("(?m)^\\s*(?:[-*+•]|[0-9]{1,2}[.)])\\s+", ""),
]
# Small capitals, letters that look Latin, and letters turned upside down.
SMALL_CAPS = ("ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴩᴘǫʀꜱᴛᴜᴠᴡʏᴢ", "abcdefghijklmnoppqrstuvwyz")
HOMOGLYPHS = (
    "аеорсухіјѕԁɡһкмтвнԛԝглпцшьъзчαβεικνορτυχωγημℓⅰⅴⅹ",
    "aeopcyxijsdghkmtbhqwrnnuwbb34abeikvoptuxwynulivx",
)
UPSIDE_DOWN = ("ɐqɔpǝɟƃɥᴉıɾʞlɯuodbɹsʇnʌʍxʎz", "abcdefghiijklmnopqrstuvwxyz")
BRAILLE = ("⠁⠃⠉⠙⠑⠋⠛⠓⠊⠚⠅⠇⠍⠝⠕⠏⠟⠗⠎⠞⠥⠧⠺⠭⠽⠵", ALPHABET)
# Glyphs that generators of fancy fonts put for letters: strokes and signs of other scripts, phonetic letters.
FANCY_STROKES = ("卂乃匚ᗪ乇千Ꮆ卄丨ﾌҜㄥ爪几ㄖ卩Ɋ尺丂ㄒㄩᐯ山乂ㄚ乙", ALPHABET)
FANCY_SIGNS = ("ค๒ς๔єŦﻮђเן๓ภ๏թợяรՇยשฬאץչ", "abcdefghijmnopqrstuvwxyz")
FANCY_PHONETIC = ("ʍɑɠɛɽʀɪʊʃʒŋðθ", "wagerriuszndt")
#: Whole alphabets of such generators; their small letters count, too.
FANCY_ALPHABETS = [
    ("ᎪᏴᏟᎠᎬᎱᎶᎻᏆᏠᏦᏞᎷᏁᎾᏢᏅᏒᏚᎢᎤᏉᏔᏫᎽᏃ", ALPHABET), ("ꍏꌃꉓꀸꍟꎇꁅꃅꀤꀭꀘ꒒ꂵꈤꂦꉣꆰꋪꌗꋖꀎꃴꅏꊼꌩꁴ", ALPHABET), ("ᥴ᥅ᥲᥒᥱꪶᧁꫝꪻꪖꫀꪑꪀꪮꪹꪊꪜꪗ", "cranelghtaemnorupy"),
]
#: Blocks of letters in another style: first and last code point, letters of the block's alphabet repeat.
STYLED = [(0x1F1E6, 0x1F1FF, 26), (0x1F130, 0x1F149, 26), (0x1F150, 0x1F169, 26), (0x1F170, 0x1F189, 26), (0x1D400, 0x1D7CB, 52)]
# Words that announce an edit of a word.
INSTRUCTIONS = "(?:add|drop|remove|without|minus|plus|swap|switch|replace|instead|change|delete|lose|take (?:off|away|out))"
# Words of a message that may be about the answer.
SUSPICIOUS = (
    "(?i)\\b(?:wordle|word of the day|today'?s word|the word|answer|solution|hint|clue|guess|rhymes?|synonym|means|meaning|definition"
    "|starts? with|ends? with|begins? with|letters?|vowels?|consonants?|first letter|last letter|spell|puzzle|streak|[0-9]/6|green|yellow|grey|gray)\\b"
    "|[\U0001F7E9\U0001F7E8⬛⬜]{3,}"
)
# Classes of an inspection's issues, first match first.
ISSUE_CLASSES = [
    ("queue", "inspection queue"), ("limit|exceeds|truncat", "inspection limit"), ("disabled", "disabled layer"),
    ("answer unavailable", "answer unavailable"), ("external|linked pages", "external content"),
    ("unsupported|unscanned|unknown", "unsupported content"), ("failed|error|timeout", "processing failure"),
]
# File name endings that carry sound and moving pictures.
AUDIO_NAMES = "(?i)\\.(?:mp3|ogg|oga|opus|wav|m4a|aac|flac|weba|wma|aiff?)$"
VIDEO_NAMES = "(?i)\\.(?:mp4|m4v|mov|webm|mkv|avi)$"


@lru_cache(maxsize=1)
def latin_folds() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode's decompositions."""
    pairs = []
    for cp in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalpha():
            pairs.append((chr(cp), base.lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@lru_cache(maxsize=1)
def style_folds() -> tuple[str, str]:
    """Letters of another style and their plain letters: the blocks of STYLED, small capitals, look-alikes, Braille, fancy fonts."""
    known: dict[str, str] = {}
    for first, last, size in STYLED:
        for cp in range(first, last + 1):
            known.setdefault(chr(cp), ALPHABET[(cp - first) % size % 26])
    # of two glyphs for one letter in a fancy font, the later table's counts
    fancy = {a: b for pair in (FANCY_STROKES, FANCY_SIGNS, FANCY_PHONETIC) for a, b in zip(*pair, strict=True)}
    for source, target in FANCY_ALPHABETS:
        for a, b in zip(source, target, strict=True):
            fancy[a] = fancy[a.lower()] = b
    for source, target in (SMALL_CAPS, HOMOGLYPHS, BRAILLE, ("".join(fancy), "".join(fancy.values()))):
        for a, b in zip(source, target, strict=True):
            known.setdefault(a, b)
    return "".join(known), "".join(known.values())
