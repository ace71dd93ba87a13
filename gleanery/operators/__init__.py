"""DataFrame operators: segmentation, rules, matching, scoring, entries, responses, reports."""
