"""What queries over one state of a table share: prepared texts, lexicon, features and signals, each written once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import signals as G
from ..sources import staging

#: States of tables that are held at most; of older ones the written tables go.
HELD = 4
_held: dict[tuple, Prepared] = {}


class Prepared:
    """Works a part out when it is first asked for; ``docs`` needs doc_id and text. ``sample``: see ``signals.mattr``."""

    def __init__(self, docs: DataFrame, lexicon: DataFrame | None = None, lang_col: str | None = None, sample: tuple[int, int] | None = None):
        self.docs, self._lexicon, self._lang_col, self._sample = docs, lexicon, lang_col, sample

    @cached_property
    def corpus(self) -> G.Corpus:
        return G.corpus(self.docs, self._lang_col)

    @cached_property
    def lexicon(self) -> DataFrame:
        return self._lexicon if self._lexicon is not None else G.corpus_lexicon(self.corpus)

    @property
    def ranked(self) -> DataFrame:
        """The lexicon for those who want nothing else: texts that are not written yet are not written for it."""
        if self._lexicon is None and not {"corpus", "lexicon"} & set(self.__dict__):
            self.__dict__["lexicon"] = G.corpus_lexicon(self.docs, lang_col=self._lang_col)
        return self.lexicon

    @cached_property
    def features(self) -> DataFrame:
        self._features = staging.Staging(self.docs.sparkSession, "features")
        return G.saved_features(self.corpus, self.lexicon, folder=self._features)

    @cached_property
    def wide(self) -> DataFrame:
        return G.document_signals(self.corpus, self.lexicon, self.features, self._sample)

    @cached_property
    def rows(self) -> DataFrame:
        return G.signals_long(self.wide)

    @cached_property
    def scores(self) -> DataFrame:
        return G.index_scores(self.wide, self.rows)

    @property
    def folders(self) -> set[str]:
        """The written tables' folders; a lexicon that was given is not among them."""
        parts = [self.__dict__[k] for k in ("lexicon", "features", "wide") if k in self.__dict__ and not (k == "lexicon" and self._lexicon is not None)]
        if "corpus" in self.__dict__:
            parts.append(self.corpus.docs)
        return {f.rpartition("/")[0] for df in parts for f in df.inputFiles()}

    def drop(self) -> None:
        """Deletes the written tables."""
        session = self.docs.sparkSession
        folders = self.folders
        # Tables in buckets that have no rows have no files either.
        for held in [self._features] * ("features" in self.__dict__) + [self.corpus] * ("corpus" in self.__dict__):
            held.drop()
        for folder in folders:
            staging.delete(session, folder)
        for k in ("corpus", "lexicon", "features", "wide", "rows", "scores"):
            self.__dict__.pop(k, None)


def state(df: DataFrame) -> tuple:
    """Files, bytes and times of change of a table, as one number each."""
    files = df.select(*[F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_modification_time")]).distinct()
    r = files.agg(F.count("*"), F.sum("file_size"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()
    return tuple(r)


def prepared(spark: SparkSession, sf_dir: str, name: str = "documents") -> Prepared:
    """The prepared parts of a table; those of an earlier query serve again while its files stay as they are."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path, state(spark.read.parquet(path)))
    found = _held.get(key)
    if found is None or not all(staging.there(spark, f) for f in found.folders):
        while len(_held) >= HELD:
            _held.pop(next(iter(_held))).drop()
        found = _held[key] = Prepared(staging.read(spark, sf_dir, name))
    return found
