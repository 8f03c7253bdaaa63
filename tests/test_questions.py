"""Question goldens (FIXTURES.md §4): gate, intent, referenced region."""

from pyspark.sql import functions as F

from kpiloom.operators.questions import gate, intent, referenced_region

CASES = [
    ("Why is revenue decreasing?", True, "general", None),
    ("Why did sales drop in March?", True, "decline", None),
    ("Which product performs the worst?", True, "worst", None),
    ("What are the major business risks?", True, "risk", None),
    ("Suggest three strategic initiatives.", False, "strategy", None),
    ("Which region should receive additional investment?", True, "invest", None),
    ("Summarize this dataset for the CEO.", True, "summary", None),
    ("How is the southeast market doing?", True, "region", "South"),
    ("What is total profit?", True, "region", "PR"),
    ("Show SP revenue please", True, "region", "SP"),
    ("hello there", True, "general", None),
    ("tell me a joke now", False, "general", None),
    ("Build a SWOT for us", True, "swot", None),
    ("Is business health good?", True, "health", None),
    ("List transactions by customer", True, "strategy", None),
]


def test_question_goldens(spark):
    df = spark.createDataFrame([(i, q) for i, (q, *_rest) in enumerate(CASES)], "qid long, q string")
    t = F.col("q")
    out = df.select("qid", gate(t).alias("g"), intent(t).alias("i"),
                    F.when(intent(t) == "region", referenced_region(t)).alias("r")).orderBy("qid").collect()
    for row, (q, g, i, r) in zip(out, CASES):
        assert (row["g"], row["i"], row["r"]) == (g, i, r), q
