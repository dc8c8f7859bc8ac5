"""Misconception rewrites: each pattern turns a correct answer into a wrong one, or null.

Registered by name; user patterns are added to the same table with register().
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import text as tx

Rewrite = Callable[[Column], Column]
REWRITES: dict[str, Rewrite] = {}


def register(name: str) -> Callable[[Rewrite], Rewrite]:
    def keep(fn: Rewrite) -> Rewrite:
        REWRITES[name] = fn
        return fn

    return keep


def has(a: Column, word: str) -> Column:
    return F.contains(F.lower(a), F.lit(word))


def swap(a: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, a)


def changed(a: Column, b: Column) -> Column:
    return F.when(b != a, b)


@register("wallet_vs_node")
def wallet_vs_node(a: Column) -> Column:
    return F.when(
        has(a, "wallet") & (has(a, "key") | has(a, "private")),
        swap(a, [("private key", "blockchain data"), ("keys", "blockchain")]),
    ).when(has(a, "node") & has(a, "validat"), swap(a, [("node", "wallet"), ("Node", "Wallet")]))


@register("mining_vs_validating")
def mining_vs_validating(a: Column) -> Column:
    mining = has(a, "mining") | has(a, "miner")
    return F.when(
        mining & has(a, "validat") & has(a, "transaction"),
        swap(a, [("validate transactions", "generate new cryptocurrency")]),
    ).when(
        mining & has(a, "block") & has(a, "create"),
        swap(a, [("create new blocks", "mine cryptocurrency rewards")]),
    )


@register("public_vs_private_key")
def public_vs_private_key(a: Column) -> Column:
    hold = "\u0003"
    return changed(
        a,
        swap(
            a,
            [
                ("private key", hold), ("public key", "private key"), (hold, "public key"),
                ("Private key", hold), ("Public key", "Private key"), (hold, "Public key"),
            ],
        ),
    )


@register("hash_vs_encryption")
def hash_vs_encryption(a: Column) -> Column:
    return F.when(has(a, "hash"), changed(a, swap(a, lx.HASH_SWAPS)))


@register("blockchain_as_database")
def blockchain_as_database(a: Column) -> Column:
    return F.when(has(a, "blockchain"), changed(a, swap(a, lx.DATABASE_SWAPS)))


@register("decentralization_equals_speed")
def decentralization_equals_speed(a: Column) -> Column:
    about = has(a, "decentral")
    return F.when(
        about & (has(a, "slow") | has(a, "time")), swap(a, [("slower", "faster"), ("slow", "fast")])
    ).when(about & has(a, "consensus"), F.concat(a, F.lit(lx.SPEED_CLAUSE)))


@register("consensus_is_voting")
def consensus_is_voting(a: Column) -> Column:
    return F.when(has(a, "consensus"), changed(a, swap(a, lx.VOTING_SWAPS)))


@register("immutable_means_unhackable")
def immutable_means_unhackable(a: Column) -> Column:
    about = has(a, "immutable") | has(a, "tamper")
    return F.when(about & has(a, "cannot be changed"), F.concat(a, F.lit(lx.UNHACKABLE_CLAUSE))).when(
        about & has(a, "permanent"), swap(a, [("permanent", "hack-proof")])
    )


@register("pow_vs_pos")
def pow_vs_pos(a: Column) -> Column:
    hold = "\u0003"
    trade = [("proof of work", hold), ("proof of stake", "proof of work"), (hold, "proof of stake")]
    return changed(a, swap(a, trade + lx.STAKE_SWAPS))


@register("gas_fees_purpose")
def gas_fees_purpose(a: Column) -> Column:
    return F.when(has(a, "gas"), changed(a, swap(a, lx.GAS_SWAPS)))


@register("smart_contract_capabilities")
def smart_contract_capabilities(a: Column) -> Column:
    about = has(a, "smart contract")
    return F.when(
        about & (has(a, "oracle") | has(a, "external")), swap(a, [("oracle", "built-in internet access")])
    ).when(about & has(a, "blockchain") & has(a, "data"), F.concat(a, F.lit(lx.API_CLAUSE)))


@register("merkle_tree_purpose")
def merkle_tree_purpose(a: Column) -> Column:
    """The wrong purpose is chosen by a hash of the answer, so runs repeat."""
    index = F.ascii(F.md5(a)) % len(lx.MERKLE_PURPOSES)
    purpose = F.get(F.array(*[F.lit(p) for p in lx.MERKLE_PURPOSES]), index)
    return F.when(
        (has(a, "merkle") | has(a, "tree")) & has(a, "verif"), F.replace(a, F.lit("verification"), purpose)
    )


def valid_distractor(d: Column, a: Column) -> Column:
    ratio = F.length(d) / F.length(a)
    return (
        d.isNotNull()
        & (F.length(a) > 0)
        & (F.lower(F.trim(d)) != F.lower(F.trim(a)))
        & ratio.between(0.5, 2.0)
        & tx.any_word(F.lower(d), lx.DISTRACTOR_TERMS)
    )


def concept_tags(a: Column) -> Column:
    low = F.lower(a)
    return F.array_compact(F.array(*[F.when(tx.any_word(low, w), F.lit(c)) for c, w in lx.TAG_WORDS.items()]))


def applicable(a: Column, difficulty: Column, name: str) -> Column:
    levels, concepts = next((lv, cs) for n, lv, _, cs in lx.PATTERNS if n == name)
    words = [w for c in concepts for w in lx.CONCEPT_WORDS[c]]
    return difficulty.isin(*levels) & tx.any_word(F.lower(a), words)
