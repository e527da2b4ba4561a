"""Queries over the driver's tables with SQL twins for checking."""


def all_queries():
    from workload import q_articles, q_crawl, q_features, q_incidents, q_models, q_text  # noqa: F401
    from workload.registry import QUERIES

    return QUERIES
