"""Masked pseudo-likelihood: a window network that predicts every word from both sides.

Words are runs without ASCII white space, A-Z lowered. ``score`` counts them exactly and trains the network of
``word_network``, whose vocabulary grows with the corpus: frequent words have an input and an output each, and the two words before and
the two after decide both the class and the word within it. A text's score is the sum of the log chances of all its
words, each given all others.

Counts are summed per slice of a task before they are shuffled. Training reads every document: each task runs
minibatch gradient descent over the documents of its partition from one common start, and the tasks' weights
are averaged, a word's by how often each task met it; the sums travel in fixed-size rows. ``EPOCHS`` rounds follow one another. Weights depend on how
the table is dealt to tasks, as any averaged training does; for a given layout reruns agree.

Null and empty texts have no word, score 0 and no mean. Rows are scored by themselves, so repeated rows get
equal scores. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeloom.llm import word_network
from codeloom.session import persist_table

EPOCHS = 1


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", epochs: int = EPOCHS) -> DataFrame:
    """Per row: ``doc_id, n_words, log_likelihood, mean_log_likelihood``."""
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counts = persist_table(word_network.counted(own.select("_text")), "word_counts")
    net = word_network.train(own.select("_text"), word_network.modelled(counts), epochs)
    scored = word_network.score(own, counts, net)
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
