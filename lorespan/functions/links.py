"""Column functions for links between pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reference_key(link: Column) -> Column:
    """The key of the page that a link names, or null where it is no reference.

    Trimmed; freed of ``[[ ]]`` around the whole; cut at the first ``|`` or ``#``; trimmed; what follows the last ``/``, in
    lower case, without a final ``.md``; runs of spaces, ``_`` and ``-`` become one ``-``, none at either end.  Null, an empty
    key and anything with ``://`` are no references.
    """
    key = F.trim(link)
    key = F.regexp_replace(key, r"(?s)\A\[\[(.*)\]\]\z", "$1")
    key = F.trim(F.regexp_replace(key, r"(?s)[|#].*", ""))
    key = F.lower(F.regexp_replace(key, r"(?s)\A.*/", ""))
    key = F.regexp_replace(F.regexp_replace(key, r"\.md\z", ""), r"[ _-]+", "-")
    key = F.btrim(key, F.lit("-"))
    return F.when(~F.contains(link, F.lit("://")) & (key != ""), key)
