r"""Words by the Unicode word-boundary rules, as one regular expression over classes of characters.

The rules join pairs of character classes; a word is a path through the automaton of the pairs that
are joined, of which a regular expression is the plain form: letters and digits in runs,
over one mid-word or mid-number mark between two of a kind; Katakana in runs; connectors between and
around all of them; marks and format characters with what they follow.  Each ideograph and Hiragana
letter is a word.  Runs of South-East Asian scripts, which need a dictionary to be cut, stay whole.
Stretches of other characters, and of connectors alone, are no words.
"""

from __future__ import annotations

# Classes of the word-break property, as contents of bracket expressions.
SOUTH_EAST_ASIAN = r"\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}"
KATAKANA = r"\p{IsKatakana}\x{3031}-\x{3035}\x{309B}\x{309C}\x{30A0}\x{30FC}\x{FF70}"
SINGLE = r"\p{IsHan}\p{IsHiragana}"
LETTER_TOO = r"\x{02C2}-\x{02C5}\x{02D2}-\x{02D7}\x{02DE}\x{02DF}\x{02E5}-\x{02EB}\x{02ED}\x{02EF}-\x{02FF}\x{055A}-\x{055C}\x{055E}\x{058A}\x{05F3}\x{A708}-\x{A716}\x{A720}\x{A721}\x{A789}\x{A78A}"
NUMERIC = r"\p{Nd}\x{066B}"
CONNECTOR = r"\p{Pc}\x{202F}"
EXTEND = r"\p{M}\x{FF9E}\x{FF9F}\x{200C}\x{200D}\x{00AD}\x{2060}-\x{2064}\x{200E}\x{200F}\x{202A}-\x{202E}\x{FEFF}"
MID_LETTER = r":\x{00B7}\x{0387}\x{055F}\x{05F4}\x{2027}\x{FE13}\x{FE55}\x{FF1A}"
MID_NUMBER = r",;\x{037E}\x{0589}\x{060C}\x{060D}\x{066C}\x{07F8}\x{2044}\x{FE10}\x{FE14}\x{FE50}\x{FE54}\x{FF0C}\x{FF1B}"
MID_BOTH = r".'\x{2018}\x{2019}\x{2024}\x{FE52}\x{FF07}\x{FF0E}"


def automaton(letter: str, numeric: str, connector: str, extend: str, katakana: str = "", single: str = "", hebrew: str = "") -> str:
    """The paths for given classes; a class is a bracket expression or one property."""
    def run(of: str) -> str:
        return f"{of}[{of}{extend}]*"

    def kind(of: str, mids: str, more: str = "", end: str = "") -> str:
        between = f"(?:[{mids}]{extend}*{more})" if more else f"[{mids}]{extend}*"
        return f"{run(of)}(?:{between}{run(of)})*{end}"

    quoted = f'|(?<={hebrew}{extend}{{0,4}})"{extend}*(?={hebrew})' if hebrew else ""
    last = f"(?:(?<={hebrew}{extend}{{0,4}})'{extend}*)?" if hebrew else ""
    words = f"(?:{kind(letter, MID_LETTER + MID_BOTH, quoted, last)}|{kind(numeric, MID_NUMBER + MID_BOTH)})+"
    part = f"(?:{words}|{run(katakana)})" if katakana else words
    join = f"[{connector}{extend}]"
    whole = f"(?:{connector}{join}*)?{part}(?:{connector}{join}*{part})*(?:{connector}{join}*)?"
    return f"{whole}|{single}{extend}*" if single else whole


#: Letters of all scripts, for Java.
UNICODE = automaton(
    rf"[[\p{{IsAlphabetic}}{LETTER_TOO}{SOUTH_EAST_ASIAN}]&&[^{SINGLE}{KATAKANA}\p{{M}}\p{{IsIdeographic}}]]",
    f"[{NUMERIC}]", f"[{CONNECTOR}]", f"[{EXTEND}]", f"[{KATAKANA}]", f"[{SINGLE}]", r"[\p{IsHebrew}&&\p{L}]")
#: The same paths where every letter is of a script written with spaces, in the syntax that RE2 shares.
PLAIN = automaton(r"\p{L}", r"\p{Nd}", r"\p{Pc}", r"\p{M}")
