"""Names as they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphweave.functions.text import strip

#: Letters that have cases. Between two of them no new word begins.
CASED = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]"
#: What becomes two letters at the start of a word, of which the second is small.
WIDE = {"ß": "Ss", "ﬀ": "Ff", "ﬁ": "Fi", "ﬂ": "Fl", "ﬃ": "Ffi", "ﬄ": "Ffl", "ﬅ": "St", "ﬆ": "St"}


def title_case(text: Column) -> Column:
    """Without blanks at its ends; each letter that follows none is a capital (or its title form), all others are small:
    `o'neil mc-donald` becomes `O'Neil Mc-Donald`."""
    # small letters first, all at once: a final sigma depends on what is around it
    words = F.regexp_extract_all(F.lower(strip(text)), F.lit(f"{CASED}+|(?!{CASED})(?s:.)"), F.lit(0))

    def shown(word: Column) -> Column:
        head, rest = F.substring(word, 1, 1), F.substr(word, F.lit(2))
        wide = F.create_map(*[F.lit(x) for pair in WIDE.items() for x in pair])
        return F.coalesce(F.concat(F.element_at(wide, head), F.lower(rest)), F.initcap(word))

    return F.array_join(F.transform(words, shown), "")
