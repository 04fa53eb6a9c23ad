"""Profiles and point reads of a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE = (
    "person string, contact struct<name:string,email:string,phone:string,location:string,links:array<struct<label:string,url:string>>>, summary string, ambitions string, target_roles array<string>, "
    "education array<struct<school:string,degree:string,start:string,end:string>>, experience array<struct<company:string,title:string,bullets:array<string>>>, "
    "projects array<struct<name:string,tagline:string,url:string,tech:array<string>,tags:array<string>,bullets:array<string>>>, skills array<struct<category:string,items:array<string>>>, achievements array<string>"
)


def read_profiles(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Profiles, one a file, or one a line, which lets files be split."""
    return spark.read.schema(PROFILE).json(path, multiLine=multi_line)


def by_uid(snapshot: DataFrame, uid: str) -> DataFrame:
    return snapshot.where(F.col("job_uid") == uid)


def distinct_sources(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("source").distinct().orderBy("source")
