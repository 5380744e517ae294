"""Graph question answering on Spark: tag, classify, look up and format, on tables and streams."""

from graphask.plans.answer_questions import QuestionEngine, build_engine, classifier_accuracy
from graphask.plans.catalog import Template, TemplateCatalog, aquaculture_catalog

__all__ = ["QuestionEngine", "Template", "TemplateCatalog", "aquaculture_catalog", "build_engine", "classifier_accuracy"]
