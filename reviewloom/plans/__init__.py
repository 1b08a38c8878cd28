"""End-to-end flows that chain the operators."""

from reviewloom.plans.flows import TopicRun, build_reviews, select_employers, topic_run, topic_runs

__all__ = ["TopicRun", "build_reviews", "select_employers", "topic_run", "topic_runs"]
