"""Queries over the test tables by name: a function of (spark, folder of tables), and SQL with the same rows or None."""

from . import analytics, audits, careers, extraction, flows, jobs, likeness, mails, matching, office, people, prose, staffing

ALL = matching.QUERIES | analytics.QUERIES | flows.QUERIES | staffing.QUERIES | people.QUERIES | audits.QUERIES | jobs.QUERIES | extraction.QUERIES | careers.QUERIES | mails.QUERIES | prose.QUERIES | likeness.QUERIES | office.QUERIES
