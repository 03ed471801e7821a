"""Synonyms: pairs closed under transitivity, kept as a canonical form for each value."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions.text import strip
from mapweave.operators.graph import components

# Fixed pairs of names that mean the same.
BUILT_IN = [("usa", "united states"), ("usa", "united states of america"), ("united states", "united states of america"), ("uk", "united kingdom"), ("uk", "great britain"), ("united kingdom", "great britain"), ("uae", "united arab emirates"), ("south korea", "korea republic"), ("south korea", "republic of korea"), ("north korea", "democratic peoples republic of korea"), ("russia", "russian federation"), ("iran", "islamic republic of iran"), ("syria", "syrian arab republic"), ("tanzania", "united republic of tanzania"), ("moldova", "republic of moldova"), ("bolivia", "plurinational state of bolivia"), ("venezuela", "bolivarian republic of venezuela"), ("congo", "democratic republic of the congo"), ("congo", "republic of the congo"), ("dr", "doctor"), ("mr", "mister"), ("mrs", "missus"), ("prof", "professor"), ("st", "saint"), ("mt", "mount"), ("ft", "fort"), ("al", "alabama"), ("ak", "alaska"), ("az", "arizona"), ("ar", "arkansas"), ("ca", "california"), ("co", "colorado"), ("ct", "connecticut"), ("de", "delaware"), ("fl", "florida"), ("ga", "georgia"), ("hi", "hawaii"), ("id", "idaho"), ("il", "illinois"), ("in", "indiana"), ("ia", "iowa"), ("ks", "kansas"), ("ky", "kentucky"), ("la", "louisiana"), ("me", "maine"), ("md", "maryland"), ("ma", "massachusetts"), ("mi", "michigan"), ("mn", "minnesota"), ("ms", "mississippi"), ("mo", "missouri"), ("mt", "montana"), ("ne", "nebraska"), ("nv", "nevada"), ("nh", "new hampshire"), ("nj", "new jersey"), ("nm", "new mexico"), ("ny", "new york"), ("nc", "north carolina"), ("nd", "north dakota"), ("oh", "ohio"), ("ok", "oklahoma"), ("or", "oregon"), ("pa", "pennsylvania"), ("ri", "rhode island"), ("sc", "south carolina"), ("sd", "south dakota"), ("tn", "tennessee"), ("tx", "texas"), ("ut", "utah"), ("vt", "vermont"), ("va", "virginia"), ("wa", "washington"), ("wv", "west virginia"), ("wi", "wisconsin"), ("wy", "wyoming"), ("hip hop", "hip-hop"), ("r&b", "rhythm and blues"), ("rnb", "rhythm and blues"), ("rock and roll", "rock & roll"), ("indie", "independent"), ("and", "&"), ("intl", "international"), ("natl", "national"), ("corp", "corporation"), ("inc", "incorporated"), ("ltd", "limited"), ("dept", "department"), ("univ", "university"), ("assoc", "association")]


def folded(c: Column) -> Column:
    return F.lower(strip(c))


def pairs(spark: SparkSession, extra: DataFrame | None = None, built_in: bool = True) -> DataFrame:
    """(a, b) of the built-in pairs and of `extra`."""
    out = spark.createDataFrame(BUILT_IN if built_in else [], "a string, b string")
    return out if extra is None else out.union(extra.select("a", "b"))


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("a string, b string").csv(path).where("a IS NOT NULL AND b IS NOT NULL")


def save_csv(synonyms: DataFrame, path: str) -> None:
    """Each value with its canonical form, without those that are their own."""
    synonyms.where("value <> canonical").select("value", "canonical").write.mode("overwrite").csv(path)


def synonyms(found: DataFrame) -> DataFrame:
    """(value, canonical): the smallest value of each group of synonyms."""
    edges = found.select(folded(F.col("a")).alias("a"), folded(F.col("b")).alias("b")).where("a <> '' AND b <> ''")
    return components(edges).toDF("value", "canonical")


def canonical(df: DataFrame, column: str, table: DataFrame, name: str) -> DataFrame:
    """`df` with the canonical form of a column; values that aren't in the table are their own."""
    t = table.toDF("syn_value", "syn_canonical")
    return df.join(t, folded(F.col(column)) == F.col("syn_value"), "left").withColumn(name, F.coalesce("syn_canonical", folded(F.col(column)))).drop("syn_value", "syn_canonical")


def synonyms_of(table: DataFrame, value: str) -> DataFrame:
    own = table.where(F.col("value") == folded(F.lit(value))).select("canonical")
    return table.join(own, "canonical", "left_semi").select("value")


def boost(pairs_: DataFrame, edges: DataFrame, table: DataFrame) -> DataFrame:
    """(ci, cj, boost): for each edge the pairs of pairs with synonymous lefts and rights, apart from pairs both sides hold. pairs_: cand, l, r."""
    c = canonical(canonical(pairs_.select("cand", "l", "r"), "l", table, "cl"), "r", table, "cr")
    a, b = (c.toDF(k, f"l{i}", f"r{i}", "cl", "cr") for k, i in (("ci", 1), ("cj", 2)))
    common = pairs_.select(F.col("cand").alias("ci"), "l", "r").join(pairs_.select(F.col("cand").alias("cj"), "l", "r"), ["l", "r"]).join(edges.select("ci", "cj"), ["ci", "cj"], "left_semi").select("ci", "cj", "l", "r").distinct()
    met = a.join(b, ["cl", "cr"]).join(edges.select("ci", "cj"), ["ci", "cj"], "left_semi")
    met = met.join(common.toDF("ci", "cj", "l1", "r1"), ["ci", "cj", "l1", "r1"], "left_anti").join(common.toDF("ci", "cj", "l2", "r2"), ["ci", "cj", "l2", "r2"], "left_anti")
    return edges.select("ci", "cj").join(met.groupBy("ci", "cj").agg(F.count("*").alias("boost")), ["ci", "cj"], "left").na.fill(0, ["boost"])
