"""What each rule is about, and what to do about its findings, in this package's own words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Description and remediation by rule.
ADVICE: dict[str, tuple[str, str]] = {
    "injection": ("Text from outside can become code, a command, a query or part of a prompt.", "Pass data as arguments or bound parameters, never as source text; keep instructions and input apart."),
    "permissions": ("The skill asks for, or uses, more rights than its task is likely to need.", "Ask for the narrowest rights that do; name paths, hosts and variables one by one, and drop what is not used."),
    "output-handling": ("Output reaches a page, a header, a path or a template without being escaped for it.", "Escape for the place where the text goes, set text instead of markup, and check paths and targets of redirects against a list."),
    "dependencies": ("A dependency is known to be unsafe, unmaintained, or not the one that was meant.", "Replace it or pin a version without the flaw, check the spelling of its name, and declare all that is imported."),
    "external-instructions": ("The skill's texts give an agent orders that a user has not given.", "Remove the orders; describe what the skill does and leave decisions to the user."),
    "storage": ("Secrets stand in files, or are kept where others can read them.", "Read secrets from a secret store when they are needed, revoke those that were committed, and use current hashes and ciphers."),
    "logging": ("Logs hold secrets or personal data, or say too little to follow what happened.", "Leave such values out of logs or mask them; log sign-ins, refusals and errors in a structured form."),
    "dos": ("A loop, an expression, a read or an allocation has no bound that input cannot exceed.", "Bound sizes, counts and times, give requests a timeout, and build no expressions from input."),
    "supply-chain": ("Code comes from elsewhere while the skill is installed or run, in a version that is not fixed.", "Pin versions and hashes, keep a lockfile, and run no script that was just downloaded."),
    "error-handling": ("Errors are swallowed, or tell callers more than they should know.", "Handle each error or pass it on, answer with a general message, and log the details."),
    "deserialization": ("Data from outside is turned into objects by a format that can run code or change prototypes.", "Use plain data formats, safe loaders and a schema; copy only the keys that are expected."),
    "web3-signing-authority": ("The skill can sign or send transactions without limits that its manifest states.", "State signers, a value for each call, contracts, chains and a daily cap, and enforce them."),
    "web3-permit-capture": ("A permit or approval can move more than is meant, or goes to a party nobody chose.", "Bound amount and deadline, take the spender from a list, and show both before signing."),
    "web3-eip7702-delegation": ("An account hands its code to a contract for longer, on more chains, or to another one than is meant.", "Allow known delegates only, name the chain, and set an end to the authorization."),
    "web3-blind-signing": ("Something is signed that its signer cannot read.", "Sign typed data with chain and contract in its domain, built by a known library, and show what it says."),
    "web3-rpc-substitution": ("Chain data or transactions go through an endpoint that can be swapped or that others can watch.", "Pin endpoints in a registry, check the chain's id, keep keys out of addresses, and use a protected relay for transactions."),
    "web3-contract-targets": ("The contract or account that is called comes from a name, a message or a history that can be forged.", "Pin addresses, compare them in checksum form, and resolve names both ways."),
    "web3-bridge-replay": ("A message between chains can be sent twice, to the wrong chain, or before it is final.", "Name the bridge, fix the destination, keep an id for each message, and wait for finality."),
    "web3-mcp-chain-drift": ("Tools that reach a chain come from servers that are not pinned, listed or declared.", "Pin servers by hash or version, use hosts from the list, and declare every tool."),
    "web3-session-key-erosion": ("A session key may do too much, for too long.", "Give it an end, a value, targets, selectors and chains, and enforce them on chain."),
    "web3-oracle-manipulation": ("A trade relies on a price or a bound that can be moved against it.", "Set a least output and a short deadline, bound slippage, and take prices from a source that a single trade cannot move."),
    "web3-key-material-leak": ("A private key or recovery phrase stands in the files or goes into a log.", "Treat it as stolen and move its funds; keep keys in a signer that never gives them out."),
    "web3-no-audit-killswitch": ("Nobody can tell afterwards what was signed, or stop it.", "Record each signature with its policy's version, and name a contract or a person that can stop the skill."),
    "web3-no-user-confirmation": ("Transactions are sent without the user's word.", "Ask before each change of state and remove flags that skip the question."),
    "web3-metadata-completeness": ("The manifest leaves out what is needed to judge the skill.", "Fill in the version, the chains, and who answers for the skill in an incident."),
    "scanner-internal": ("A check failed on a file, so that file is not covered by it.", "Read the message, and run the audit again with the check repaired."),
}


def explained(findings: DataFrame) -> DataFrame:
    """The findings with ``description`` and ``remediation`` of their rules; null for rules of plugins."""
    rows = [(rule, *texts) for rule, texts in ADVICE.items()]
    table = findings.sparkSession.createDataFrame(rows, "rule string, description string, remediation string")
    return findings.join(F.broadcast(table), "rule", "left")
