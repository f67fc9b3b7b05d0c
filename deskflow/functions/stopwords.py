"""English stop words: Spark ML's own default list (``StopWordsRemover``).

Read straight from the installed Spark ML jar so the Spark jobs and the SQL
oracle use the identical list without starting a JVM; falls back to asking
Spark when the jar is not found.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

_RESOURCE = "org/apache/spark/ml/feature/stopwords/english.txt"


@functools.lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    import pyspark
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    for j in jars:
        with zipfile.ZipFile(j) as z:
            if _RESOURCE in z.namelist():
                return tuple(z.read(_RESOURCE).decode("utf-8").split())
    from pyspark.ml.feature import StopWordsRemover
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))
