"""Saving and loading fitted pipelines."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from functools import lru_cache

from pyspark.ml import Model, PipelineModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import SparkSession


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


class JoinedSaver:
    """Saves many pipelines of one encoder and a booster each, as :func:`save_model` does.

    Saving a stage takes jobs, and the encoder has ten stages; so it is saved once, and its folders are copied for each pipeline.
    """

    def __init__(self, spark: SparkSession, encoder: PipelineModel, path: str):
        self.spark, self.path, self.uids = spark, save_model(encoder, path), [stage.uid for stage in encoder.stages]
        self.metadata = json.loads(spark.read.text(f"{path}/metadata").first()["value"])

    def save(self, model: Model, path: str) -> str:
        hadoop, configuration = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        system = hadoop.Path(path).getFileSystem(configuration)
        system.delete(hadoop.Path(path), True)
        uids = [*self.uids, model.uid]
        places = [f"{path}/stages/{_stage_folder(i, uids)}" for i in range(len(uids))]
        system.mkdirs(hadoop.Path(path, "stages"))
        for i, place in enumerate(places[:-1]):
            saved = hadoop.Path(f"{self.path}/stages/{_stage_folder(i, self.uids)}")
            if not hadoop.FileUtil.copy(system, saved, system, hadoop.Path(place), False, configuration):
                raise OSError(f"cannot write {place}")
        model.write().save(places[-1])
        described = {"uid": f"PipelineModel_{uuid.uuid4().hex[-12:]}", "timestamp": int(time.time() * 1000), "paramMap": {"stageUids": uids}}
        # Last, and with the mark of a finished write: without it nothing can be loaded from here.
        for name, text in (("part-00000", json.dumps(self.metadata | described) + "\n"), ("_SUCCESS", "")):
            stream = system.create(hadoop.Path(f"{path}/metadata/{name}"), True)
            stream.write(bytearray(text.encode()))
            stream.close()
        return path


def _stage_folder(i: int, uids: Sequence[str]) -> str:
    return f"{i:0{len(str(len(uids)))}d}_{uids[i]}"


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_last_stage(spark: SparkSession, path: str) -> GBTRegressionModel:
    """The booster of a saved regressor alone, for rows that are encoded already.

    Each stage lies in a folder of its own, by number, and reading one takes several short jobs.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path, "stages")
    stages = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [stage.getPath().getName() for stage in stages if stage.isDirectory()]
    return GBTRegressionModel.load(f"{path}/stages/{max(names, key=lambda name: int(name.split('_')[0]))}")


def cached_model(path: str) -> PipelineModel:
    """A model that is asked for again and again, as in an interactive session.

    A saved model is known by its path, when it was written and the session that loaded it,
    so an overwritten one is loaded anew.
    """
    spark = SparkSession.getActiveSession()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path, "metadata")
    status = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    written = max(file.getModificationTime() for file in status)
    return _loaded(path, written, spark.sparkContext.applicationId)


@lru_cache(maxsize=16)
def _loaded(path: str, written: int, session: str) -> PipelineModel:
    return load_model(path)


def period_path(root: str, label: str) -> str:
    """One folder per training period, labelled ``<first day>_to_<last day>``."""
    return f"{root.rstrip('/')}/period={label}"
