"""SQL of the count classifier, given queries for its training rows and its texts."""

from __future__ import annotations

_WORDS = "list_filter(string_split_regex(question, '[^0-9a-z'']+'), lambda w: w <> '')"


def nb_views(train: str, test: str) -> dict[str, str]:
    return dict(
        train_v=train,
        test_v=test,
        tok_v=f"SELECT label, unnest({_WORDS}) AS token FROM train_v",
        cnt_v="SELECT label, token, count(*) AS c FROM tok_v GROUP BY label, token",
        lab_v="SELECT label, ln(n / (SELECT count(*) FROM train_v)) AS prior, ln(total + (SELECT count(DISTINCT token) FROM cnt_v)) AS den FROM "
        "(SELECT label, count(*) AS n FROM train_v GROUP BY label) a JOIN (SELECT label, sum(c) AS total FROM cnt_v GROUP BY label) b USING (label)",
        known_v=f"SELECT question, token FROM (SELECT question, unnest({_WORDS}) AS token FROM test_v) x WHERE token IN (SELECT token FROM cnt_v)",
        score_v="SELECT t.question, l.label, round(l.prior - coalesce(k.n, 0) * l.den + coalesce(s.s, 0), 9) AS score FROM test_v t CROSS JOIN lab_v l "
        "LEFT JOIN (SELECT question, count(*) AS n FROM known_v GROUP BY question) k USING (question) "
        "LEFT JOIN (SELECT question, label, sum(ln(c + 1)) AS s FROM known_v JOIN cnt_v USING (token) GROUP BY question, label) s ON s.question = t.question AND s.label = l.label",
        rank_v="SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, label) AS rn, "
        "exp(score - max(score) OVER (PARTITION BY question)) / sum(exp(score)) OVER (PARTITION BY question) * exp(max(score) OVER (PARTITION BY question)) AS proba FROM score_v",
    )
