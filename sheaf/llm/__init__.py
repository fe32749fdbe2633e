"""Operators for preparing training data at scale; each module is one operator.

Nothing outside this subpackage imports it. Executors import it by name, so ship the
package with ``--py-files`` or ``addArtifacts`` where it is not installed.
"""
