"""The notebook questions as DataFrame programs over abbreviated triples.

``QUESTIONS`` maps each question's uid to a function of the triples.
"""

from tessella.questions import empirical, empirical_trends, language, language_survey  # noqa: F401
from tessella.questions.common import QUESTIONS

__all__ = ["QUESTIONS"]
