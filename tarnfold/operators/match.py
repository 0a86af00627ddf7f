"""Boolean and phrase matching, and BM25, over the postings.

All terms of a query read the postings once. A term is a sequence of tokens (a word with punctuation inside
is one of several), the last of which may be a prefix; each row tells at which places of which terms it can
stand. Occurrences of a term are the starts at which all of its places are filled in one field: one shuffle
by document, field and start, for several tokens only. Then one aggregation a document gives all term
frequencies beside what the postings carry of it, from which AND, OR, NOT, filters, counts, document frequencies and the
rank follow in projections. Document frequencies enter the rank as a scalar subquery over the same aggregation, whose
shuffle is used for both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.operators.index import CARRIED, Index
from tarnfold.plans.query_lang import FIELDS, Plan, Term

#: Weights of the four fields; saturation and length constants of BM25; the floor of idf.
WEIGHTS = (8.0, 5.0, 0.3, 1.5)
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _places(term: Term) -> list[tuple[int, Column]]:
    """(offset, which rows may stand there) for each token."""
    ts = term.tokens()
    out = []
    for i, t in enumerate(ts):
        fits = F.col("term").startswith(t) if term.prefix and i == len(ts) - 1 else F.col("term") == t
        out.append((i, fits & (F.col("field") == FIELDS.index(term.column)) if term.column else fits))
    return out


def occurrences_of(index: Index, terms: list[Term]) -> DataFrame:
    """(doc_id, what is carried, term_no, field), a row for each occurrence of each term. A term without tokens has none."""
    places = [(no, len(term.tokens()), at, fits) for no, term in enumerate(terms) for at, fits in _places(term)]
    if not places:
        return index.postings.where(F.lit(False)).select("doc_id", *CARRIED, F.lit(0).alias("term_no"), "field")
    rows = index.postings.where(reduce(lambda a, b: a | b, [p[3] for p in places]))
    made = F.array(*[F.when(fits, F.struct(F.lit(no).alias("term_no"), F.lit(size).alias("size"), F.lit(at).alias("at"))) for no, size, at, fits in places])
    each = rows.select("doc_id", *CARRIED, "field", "pos", F.explode(F.filter(made, lambda p: p.isNotNull())).alias("p")).select("doc_id", *CARRIED, "field", "pos", "p.*")
    single = each.where("size = 1").select("doc_id", *CARRIED, "term_no", "field")
    if all(p[1] == 1 for p in places):
        return single
    full = each.where("size > 1").groupBy("doc_id", *CARRIED, "term_no", "field", "size", (F.col("pos") - F.col("at")).alias("start")).agg(F.count_distinct("at").alias("filled")).where("filled = size")
    return single.unionByName(full.select("doc_id", *CARRIED, "term_no", "field"))


def hits(index: Index, terms: list[Term]) -> DataFrame:
    """(doc_id, term_no, field, n): how often each term occurs in each field."""
    return occurrences_of(index, terms).groupBy("doc_id", "term_no", "field").agg(F.count("*").alias("n"))


def weighted(index: Index, plan: Plan) -> DataFrame:
    """(doc_id, what is carried, tf_0.. for the plan's used terms, then its negatives): all documents with any of them.

    What is summed are whole numbers for each term and field; weights come after, in a fixed order, so
    results do not depend on how rows were dealt. What is carried follows from doc_id and so may be grouped by.
    """
    terms = [*plan.used, *plan.negatives]
    n = lambda i, f: F.count_if((F.col("term_no") == i) & (F.col("field") == f)).alias(f"n_{i}_{f}")
    per_doc = occurrences_of(index, terms).groupBy("doc_id", *CARRIED).agg(*[n(i, f) for i in range(len(terms)) for f in range(len(FIELDS))])
    tf = lambda i: reduce(lambda a, b: a + b, [F.lit(w) * F.col(f"n_{i}_{f}") for f, w in enumerate(WEIGHTS)])
    return per_doc.select("doc_id", *CARRIED, *[tf(i).alias(f"tf_{i}") for i in range(len(terms))])


def condition(plan: Plan) -> Column:
    """The plan's boolean form over tf_0..: used terms first, then the negatives."""
    n = len(plan.used)
    has = [F.col(f"tf_{i}") > 0 for i in range(n + len(plan.negatives))]
    wanted = reduce((lambda a, b: a & b) if plan.joiner == "AND" else (lambda a, b: a | b), has[:n], F.lit(plan.joiner == "AND") if n else F.lit(False))
    return reduce(lambda a, b: a & ~b, has[n:], wanted)


def matches(index: Index, plan: Plan) -> DataFrame:
    """The documents that match: (doc_id, what is carried, tf_0..)."""
    return weighted(index, plan).where(condition(plan))


def document_counts(plan: Plan) -> Column:
    """An aggregate over `weighted`: struct(df_0..), in how many documents each term is, whatever filters a search adds."""
    terms = [*plan.used, *plan.negatives]
    return F.struct(*[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))])


def with_rank(found: DataFrame, index: Index, plan: Plan, counts: Column | list[int]) -> DataFrame:
    """found with rank, lower is better. Terms add up in the query's order, so sums don't vary. counts: df of each used term."""
    df = [F.lit(c) for c in counts] if isinstance(counts, list) else [counts[f"df_{i}"] for i in range(len(plan.used))]
    norm = (1 - B + B * F.col("n_tokens") / index.avg_len) * K1 if index.avg_len else F.lit(K1)

    def part(i: int) -> Column:
        x = F.log((F.lit(float(index.n_docs)) - df[i] + 0.5) / (df[i] + 0.5))
        return F.when(x > 0, x).otherwise(LEAST_IDF) * F.col(f"tf_{i}") * (K1 + 1) / (F.col(f"tf_{i}") + norm)

    return found.withColumn("rank", -reduce(lambda a, b: a + b, map(part, range(len(plan.used))), F.lit(0.0)))


def ranked(index: Index, plan: Plan) -> DataFrame:
    """(doc_id, what is carried, rank) of the matching documents."""
    rows = weighted(index, plan)
    if not plan.used:
        return rows.where(F.lit(False)).select("doc_id", *CARRIED, F.lit(0.0).alias("rank"))
    return with_rank(rows.where(condition(plan)), index, plan, rows.agg(document_counts(plan)).scalar()).select("doc_id", *CARRIED, "rank")
