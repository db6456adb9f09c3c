"""Operators: functions from DataFrames to DataFrames, lazy unless they say otherwise.

Lines are (ep, id, t, spk, text) or, without text, (ep, id, t, spk, words, chars): the episode, an order within a second,
the start in seconds, the speaker ('' if unknown). Windows are partitioned by episode, which bounds a group by the length of
a recording.
"""
