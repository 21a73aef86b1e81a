"""White space and pattern conventions shared by all text operators.

Patterns follow the reading of text by code points with the Unicode white space below; the class is spelled
out because the short class of Java's patterns leaves U+001C to U+001F out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same as the body of a pattern's character class.
W = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
S = f"[{W}]"
N = f"[^{W}]"


def strip(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.btrim(text, F.lit(WS_CHARS))
